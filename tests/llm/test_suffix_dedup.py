import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaic.llm import suffix_dedup as s


def brute(rows):
    """Per row, which bytes go."""
    texts = [(10**18 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for p in range(len(b) - s.WINDOW + 1):
            w = b[p : p + s.WINDOW]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - s.WINDOW + 1):
            if first[b[p : p + s.WINDOW]] < i:
                gone[p : p + s.WINDOW] = b"\1" * s.WINDOW
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def report(df):
    return sorted((10**18 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def check(spark, rows, parts=3, **limits):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert report(s.deduplicate(df, rewrite=False, **limits)) == brute(rows)


SMALL = {"chunk_bytes": 3000, "samples": 200, "run_bytes": 3000}


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    alphabet = ["ab", "abcdefghij ", "é日 x"][seed]
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.choice((20, 49, 50, 51, 90, 300)))) for _ in range(12)]
    rows = [(rng.randrange(60), "".join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(rng.randrange(6)))) for _ in range(60)]
    check(spark, rows, **SMALL)


def test_edges(spark):
    w = "".join(map(chr, range(40, 90)))  # 50 characters
    rows = [(1, w), (2, w), (3, w[:49]), (4, "x" + w + "y"), (5, w + w), (5, w), (None, w + "z"), (6, None), (7, ""), (8, "a" * 500), (9, "a" * 120), (10, "\0" * 60), (11, "q\0" + "\0" * 55), (12, w[1:] + "!"), (13, w[1:] + "!")]
    check(spark, rows, **SMALL)
    check(spark, rows)


def test_query(spark, sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert report(s.query(spark, sample)) == brute(rows)
    assert report(s.deduplicate(sample.select("doc_id", "text").repartition(4), rewrite=False, chunk_bytes=50_000, samples=5000, run_bytes=40_000)) == brute(rows)


def test_all_columns_pass(spark, odd, none):
    docs = odd.withColumn("chunk", F.lit(1)).withColumn("payload", F.lit("p")).withColumn("n_removed", F.lit("old")).withColumn("answers", F.array(F.lit(1)))
    got = s.deduplicate(docs)
    assert set(docs.columns) <= set(got.columns) and got.count() == docs.count()
    twice = {(r.doc_id, r.source): r for r in got.collect()}
    assert twice[1, "a"].n_removed == 0 and twice[2, "b"].text == "" and twice[3, None].text is None and twice[3, None].answers == [1]
    assert s.deduplicate(none).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, 120, dtype=np.uint8)) for _ in range(30)] + [b"a" * 100, b"a" * 100]
    raw = np.frombuffer(b"".join(t + bytes(56) for t in texts), np.uint8)
    at = np.concatenate([np.arange(len(t) - 49) + i * 0 + sum(len(x) + 56 for x in texts[:i]) for i, t in enumerate(texts)])
    data = raw.tobytes()
    got = s.sort_suffixes(raw, at.copy())
    assert sorted(got.tolist()) == sorted(at.tolist())
    keys = [data[p : p + 56] for p in got]
    assert keys == sorted(keys)


def test_covers():
    for period, cover in ((s.COVER, s.COVER_SET), (s.SMALL, s.SMALL_SET)):
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("bits", [7, 40, 64])
def test_numbers_are_sorted_with_their_places(bits):
    """Packed into 64 bits where both fit (7, 40), by an indirect sort where they don't (64)."""
    key = np.random.default_rng(2).integers(0, 2**bits, 5000, dtype=np.uint64, endpoint=False)[np.random.default_rng(3).integers(0, 3000, 5000)]
    order, new = s._sorted(key, bits)
    assert sorted(order.tolist()) == list(range(5000)) and (key[order] == np.sort(key)).all()
    assert (s._ranked(key, bits) == np.unique(key, return_inverse=True)[1]).all() and new.sum() == len(np.unique(key))
    assert len(s._sorted(key[:0], bits)[0]) == len(s._sorted(key[:0], bits)[1]) == 0


def test_candidates_are_windows_around_samples():
    """Documents shorter than a window, of a window and of more, empty ones; samples of some of them only."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(97, 123, n))) for n in (400, 0, 49, 50, 51, 0, 130, 20, 300)]
    sink = pa.BufferOutputStream()
    table = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    chunk = s.Chunk(sink.getvalue().to_pybytes(), "doc_id", "text")
    at, _, doc = chunk.samples()
    ends = chunk.end.tolist()
    want = [p for p in range(len(chunk.raw)) if p % s.COVER in s.COVER_SET and p + s.SAMPLE <= next(e for e in ends if e > p)]
    assert at.tolist() == want and doc.tolist() == [next(i for i, e in enumerate(ends) if e > p) for p in want]
    for some in (at, at[::7], at[3:4], at[:0]):
        starts = [p for p in range(len(chunk.raw)) if p + s.WINDOW <= next(e for e in ends if e > p) and any(p <= a < p + s.COVER for a in some)]
        assert chunk.candidates(some).tolist() == starts


def test_texts_with_zero_bytes(spark):
    """Zero bytes within texts are text; what follows them decides the order."""
    rng = random.Random(8)
    pool = ["\0" * 20 + "".join(rng.choice("ab") for _ in range(40)) for _ in range(12)]
    check(spark, [(i, "".join(rng.choice(pool) for _ in range(3))) for i in range(60)])
    texts = [rng.choice(pool).encode() for _ in range(60)]
    raw = np.frombuffer(b"".join(t + bytes(56) for t in texts), np.uint8)
    got = s.sort_suffixes(raw, np.arange(60) * 116)
    assert [raw[p : p + 50].tobytes() for p in got] == sorted(t[:50] for t in texts)


def test_a_bucket_takes_bounded_memory():
    """Sorting numbers takes little more than twice what they take themselves, a bucket of windows less than 55 times its bytes."""
    import tracemalloc

    import pyarrow as pa

    key = np.random.default_rng(5).integers(0, 2**40, 1 << 20, dtype=np.uint64)
    rng = np.random.default_rng(6)
    many = np.full(4000, 100, np.int32)
    body = rng.integers(97, 123, 4000 * 149, dtype=np.uint8)
    table = pa.table({"bucket": [0], "chunk": [0], "body": [s._squeezed(body)], "many": [s._squeezed(many)], "ids": [s._squeezed(np.arange(4000))]})
    for run, most in ((lambda: s._sorted(key, 40), 2.2 * key.nbytes), (lambda: s._runs_answered(table), 55 * len(body))):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most, (peak, most)
