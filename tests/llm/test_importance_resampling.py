import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np

from voltaic.llm import importance_resampling as resampling


def brute(docs, target):
    """Rows of the query, from dictionaries of whole texts."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        return [zlib.crc32(w.encode()) % 10_000 for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(low))]

    own = [(i, features(t)) for i, t in docs]
    s, t = collections.Counter(b for _, f in own for b in f), collections.Counter(b for x in target for b in features(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in range(10_000)]
    out = []
    for i, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((o for o in out if o[1] >= 20), key=lambda o: (-o[3], o[0] is None, o[0]))
    for k, o in enumerate(able[: 10 * len(able) // 100]):
        o[4] = k + 1
    return sorted(map(repr, out))


def rows_of(df):
    return sorted(repr(list(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_query_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 7)
    monkeypatch.setattr(resampling, "PIECE", 50)
    monkeypatch.setattr(resampling, "REMEMBERED", 20)
    r = random.Random(3)
    vocab = ["The", "house", "été", "x1", "日本", "don't", "far-off", "a"] + [f"w{i}" for i in range(100)]
    docs = [(i, " ".join(r.choices(vocab, k=r.choice([0, 5, 19, 20, 30, 200])))) for i in range(500)] + [(900, None), (901, "é" * 500), (902, "--- \n")]
    target = [" ".join(r.choices(vocab[:20], k=30)) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, weight int").repartition(6)
    assert rows_of(resampling.query(spark, df, spark.createDataFrame([(t,) for t in target], "text string"))) == brute(docs, target)


def test_sample_matches_brute_force(spark, sample):
    docs = [(r.doc_id, r.text) for r in sample.collect()]
    target = [docs[i][1] for i in range(0, 40, 2)]
    assert rows_of(resampling.resample(sample, spark.createDataFrame([(t,) for t in target], "text string"))) == brute(docs, target)


def test_nulls_repeats_and_empty_tables(spark, odd, none):
    texts = spark.createDataFrame([("the quick brown fox",)], "text string")
    assert resampling.resample(none, texts).count() == 0
    assert rows_of(resampling.resample(odd, none)) == brute([(r.doc_id, r.text) for r in odd.collect()], [])
    many = odd.crossJoin(spark.range(40).select("id")).drop("id")
    ranks = resampling.resample(many, texts)
    assert ranks.count() == many.count()
    got = sorted(r["rank"] for r in ranks.where("rank is not null").collect())
    assert got == list(range(1, len(got) + 1)) and got
    assert resampling.drawn(many, ranks).where("text is null").count() == 0


def test_the_stored_matrix_is_whole(spark, sample):
    """Rows of the blocks hold each document's counts; column sums are their sums."""
    stored = resampling.matrix(sample).collect()
    seen, total = {}, np.zeros(10_000, np.int64)
    for b in stored:
        starts, at, counts = (np.frombuffer(x, t) for x, t in ((b.starts, np.int64), (b.buckets, np.int32), (b.counts, np.int64)))
        for k, i in enumerate(b.doc_ids):
            seen[i] = dict(zip(at[starts[k] : starts[k + 1]].tolist(), counts[starts[k] : starts[k + 1]].tolist()))
            assert sum(seen[i].values()) == b.words[k]
        np.add.at(total, at, counts)
    assert len(seen) == sample.count()
    assert (resampling.column_sums(resampling.matrix(sample)) == total).all()
