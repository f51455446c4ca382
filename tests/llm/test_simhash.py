import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voltaic.llm import components, near_copies, simhash


def brute_fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, pairs):
    """Smallest reachable node of each."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(fps, most):
    return [(a, b) for i, a in enumerate(fps) for b in np.array(fps[:i], np.int64)[np.bitwise_count(np.array(fps[:i], np.int64) ^ np.int64(a)) <= most].tolist()] if fps else []


def clustered(rng, n):
    base = [rng.getrandbits(64) for _ in range(n // 10)]
    out = set()
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        out.add(x - (1 << 64) if x >> 63 else x)
    return sorted(out)


def test_golay_code_is_perfect():
    rest, leader = simhash._golay()
    assert len(set(leader.tolist())) == 2048 and np.bitwise_count(leader).max() == 3
    words = np.arange(4096) << 11 | rest
    assert np.bitwise_count(words[1:]).min() == 7


@pytest.mark.parametrize("most,bands,direct", [(2, simhash.TWO_BLOCKS, 0), (1, simhash.TWO_BLOCKS, 0), (8, simhash.THREE_BANDS, 0), (11, simhash.THREE_BANDS, 400)])
def test_no_link_is_missed(spark, most, bands, direct):
    fps = clustered(random.Random(most), 400)
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), most, bands, direct).collect()
    assert all(r.a > r.b or direct for r in got)
    assert groups(fps, [(r.a, r.b) for r in got]) == groups(fps, near(fps, most))
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= most for r in got if direct or not r.star)


def test_a_large_group_gives_few_rows(spark):
    fps = [a | b << 20 | c << 40 for a in (0, 1, 2, 4) for b in (0, 1, 2, 4, 8) for c in range(0, 64)]
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 2).collect()
    assert groups(fps, [(r.a, r.b) for r in got]) == groups(fps, near(fps, 2)) and len(got) < 40 * len(fps)


def test_stars(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)]
    got = {r.node: r.root for r in components.stars(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if k != v}
    assert components.stars(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = (np.array(x) for x in zip(*pairs))
    assert components.least_labels(a, b, 1201)[[p for x in pairs for p in x]].tolist() == [want[p] for x in pairs for p in x]


def test_query(spark, sample, odd, none):
    docs = sample.unionByName(odd.where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 1000)).withColumn("fp", F.lit(1)).withColumn("root", F.lit(1))
    got = simhash.query(spark, docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    fp = {d: brute_fingerprint(t) for d, t in texts.items()}
    assert len(got) == docs.count()
    assert all(r.fingerprint == f"{fp[r.doc_id]:016x}" for r in got)
    pairs = [(a, b) for i, a in enumerate(sorted(fp)) for b in sorted(fp)[:i] if bin(fp[a] ^ fp[b]).count("1") <= 2]
    want = groups(fp, pairs)
    assert {r.doc_id: r.component_id for r in got} == want
    assert simhash.query(spark, none).count() == 0
    assert [r.component_id for r in simhash.query(spark, odd.where("doc_id is null")).collect()] == [None]


def test_overlap():
    a, b = np.arange(100, dtype=np.uint64), np.arange(20, 120, dtype=np.uint64)
    assert near_copies.overlap(a.tobytes(), b.tobytes()) == pytest.approx(80 / 120)
    assert near_copies.overlap(b"", b"") == 1.0 and near_copies.overlap(b"", a.tobytes()) == 0.0


def test_survivors_match_brute_force(spark, sample, none):
    docs = sample.select("doc_id", "text")
    rng = random.Random(2)
    more = []
    for i, r in enumerate(sample.where("length(text) > 1500").limit(20).collect()):
        words = r.text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        more.append((10_000 + i, " ".join(words)))
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    shingles = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        shingles[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    ids = sorted(shingles)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    want = set(groups(ids, pairs).values())
    got = {r.doc_id for r in near_copies.survivors(docs).collect()}
    assert got == want and not got & {m[0] for m in more}
    assert near_copies.survivors(none).count() == 0


def test_more_partners_than_are_named(spark, monkeypatch):
    """A hundred near copies of each of two unlike texts, with few partners named directly."""
    rng = random.Random(8)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(400)] for _ in range(2)]
    rows = []
    for i in range(200):
        words = list(base[i % 2])
        words[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(near_copies, "DIRECT", 2)
    got = {r.doc_id for r in near_copies.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0, 1}


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_roots_by_stars_and_in_one_task(spark, monkeypatch, most):
    monkeypatch.setattr(components, "FEW_LINKS", most)
    r = np.random.default_rng(8)
    links = r.integers(0, 60, (40, 2))
    got = {x.node: x.root for x in components.roots(spark.createDataFrame(links.tolist(), "a long, b long")).collect()}
    label = components.least_labels(links[:, 0], links[:, 1], 60)
    assert got == {i: int(label[i]) for i in range(60) if label[i] != i}
