import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaic.llm import cube_mixing as c


def water_fill(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Targets by sharing the excess again and again. sizes: by source in order."""
    cap = {s: most * n for s, n in sizes.items()}
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(sizes)}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap[s]}
        if not full:
            out |= {s: level * w[s] for s in open_}
            break
        out |= {s: cap[s] for s in full}
        left -= sum(cap[s] for s in full)
        open_ -= full
    return out


def order(s):
    return (s is None, s or "")


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 50, "c": 1000, "d": 3, "é": 500}, {"a": 10}, {"a": 0, "b": 10, None: 30}])
def test_targets(spark, sizes):
    sizes = dict(sorted(sizes.items(), key=lambda x: order(x[0])))
    df = spark.createDataFrame([(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in c.targets(df).collect()}
    assert got == pytest.approx(water_fill(sizes))


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 3000, 400).astype(float)
    p = np.full(400, 0.37)
    q = c.flight(p, size)
    assert ((q > 0) & (q < 1)).sum() <= 2 and q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())
    same = c.flight(np.full(50, 0.5), np.full(50, 7.0))
    assert ((same > 0) & (same < 1)).sum() <= 2 and same.sum() == pytest.approx(25)
    assert c.flight(np.array([0.0, 1.0, 0.3]), np.array([1.0, 2.0, 3.0])).tolist() == [0.0, 1.0, 0.3]


def test_landing():
    assert c.landing(np.array([0.5, 0.5]), np.array([10.0, 10.0])).sum() == 1
    assert c.landing(np.empty(0), np.empty(0)).tolist() == []


def test_query(spark, sample):
    rows = {r.doc_id: r for r in c.query(spark, sample).collect()}
    texts = {r.doc_id: (r.text, r.source) for r in sample.collect()}
    per = {}
    for d, (t, s) in texts.items():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert rows[d].size == n and 0 <= rows[d].taken <= 2 * n and (n == 0 or rows[d].taken % n == 0)
        per[s] = per.get(s, 0) + n
    want = water_fill(dict(sorted(per.items(), key=lambda x: order(x[0]))))
    took = {}
    for d, (t, s) in texts.items():
        assert rows[d].target == pytest.approx(want[s]) and rows[d].source_size == per[s]
        took[s] = took.get(s, 0) + rows[d].taken
    for s in per:
        assert abs(took[s] - want[s]) <= 0.1 * want[s] + 100
    again = {r.doc_id: r.taken for r in c.query(spark, sample.repartition(5)).collect()}
    assert again == {d: r.taken for d, r in rows.items()}


def test_blocks_meet_again(spark, monkeypatch):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("source"), (F.col("id") % 97 + 3).alias("size"))
    monkeypatch.setattr(c, "BLOCK", 500)
    got = c.mix(df).groupBy("source").agg(F.sum(F.col("times") * F.col("size")).alias("took"), F.first("target").alias("target")).collect()
    assert all(abs(r.took - r.target) < 0.001 * r.target for r in got)


def test_reruns_agree_under_any_partitions(spark):
    """More documents a source than a block holds, with repeated rows, and ids that doubles can't hold."""
    docs = spark.range(30_000).select(
        F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 7 == 0, F.lit(2**62 + 1)).otherwise(F.col("id") + 2**60).alias("doc_id"),
        F.element_at(F.array(*[F.lit(x) for x in "abc"]), (F.col("id") % 3 + 1).cast("int")).alias("source"), (F.xxhash64("id") % 300 + 320).alias("size"),
    )
    want = None
    for n in (1, 7, 40):
        got = sorted(map(tuple, c.mix(docs.repartition(n)).groupBy("doc_id", "source", "size", "times").count().collect()), key=repr)
        assert want is None or got == want
        want = got
    assert sum(r[4] for r in want) == 30_000 and {2**60 + 1, None, 2**62 + 1} <= {r[0] for r in want}


def test_numbers_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 10)
    rows = spark.createDataFrame([(1, "a")] * 37 + [(2, None)] * 10 + [(None, "b")], "doc_id long, source string")
    got = {}
    for r in c.numbered(rows).collect():
        got.setdefault((r.doc_id, r.source), []).append(r.tie_)
    assert {k: sorted(v) for k, v in got.items()} == {(1, "a"): list(range(37)), (2, None): list(range(10)), (None, "b"): [0]}


def test_odd_rows(spark, odd, none):
    docs = odd.withColumn("target", F.lit(1)).withColumn("rank_", F.lit(2))
    got = c.query(spark, docs).collect()
    assert len(got) == docs.count() and all(r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) > 0 and {r.taken for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert c.query(spark, none).count() == 0
    blank = odd.where("doc_id in (3, 4, 5)")
    assert [r.taken for r in c.query(spark, blank).collect()] == [0, 0, 0]
