import zlib

import pytest
from pyspark.sql import functions as F

from voltaic.llm import histogram_sort as h


def check(got, shards):
    """Slots gapless from 0, keys in order of shard and slot; bytes per shard."""
    own = {}
    for r in got:
        own.setdefault(r.shard, []).append(r)
    for rows in own.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    keys = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    rank = [-(10**20) if k is None else k for k in keys]
    assert rank == sorted(rank)
    return [sum(r.size or 0 for r in own.get(i, [])) for i in range(shards)]


@pytest.mark.parametrize("parts", [20_000_000, 300])
def test_even_bytes(spark, parts):
    df = spark.range(5000).select((F.col("id") * F.col("id") - 7).alias("doc_id"), (F.col("id") % 13 + 1).alias("size"))
    got = h.shard_by_bytes(df, shards=7, rows_per_task=parts).collect()
    sizes = check(got, 7)
    assert len(got) == 5000 and max(sizes) - min(sizes) < 60


def test_one_key_of_a_third(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit(2).alias("size"))
    sizes = check(h.shard_by_bytes(df, shards=10).collect(), 10)
    assert max(sizes) - min(sizes) <= 8


@pytest.mark.parametrize(
    "keys",
    [[-(2**63) + 5, 0, 2**63 - 2, 17], [None, None, 3, 3], [1], [2**62, 2**62 + 1, -(2**62) - 9, None], [2**63 - 1, 5, 7, 9], [None, -(2**63), 2**63 - 1, 0], [2**63 - 1], [-(2**63), None], [None]],
)
def test_extreme_keys(spark, keys):
    df = spark.createDataFrame([(k, 10) for k in keys for _ in range(20)], "doc_id long, size long")
    sizes = check(h.shard_by_bytes(df, shards=4).collect(), 4)
    assert sum(sizes) == 10 * 20 * len(keys) and max(sizes) - min(sizes) <= 40


def test_keys_a_step_apart_over_the_whole_range(spark):
    rows = [(-(2**63) + i * (2**64 // 999), 3) for i in range(1000)]
    sizes = check(h.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, size long"), shards=8).collect(), 8)
    assert max(sizes) - min(sizes) <= 3


def test_several_large_keys(spark):
    """Cuts inside different keys are searched together."""
    df = spark.range(4000).select((F.col("id") % 3 * 10).alias("doc_id"), (F.col("id") % 5 + 1).alias("size"))
    sizes = check(h.shard_by_bytes(df, shards=16).collect(), 16)
    assert max(sizes) - min(sizes) <= 12


def test_no_weight_and_nulls(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 0, "x") for i in range(40)], "doc_id long, size long, Shard string")
    got = h.shard_by_bytes(df, shards=4)
    assert got.columns.count("shard") == 1 and "Shard" not in got.columns
    assert sorted(got.groupBy("shard").count().collect()) == [(i, 10) for i in range(4)]
    assert h.shard_by_bytes(df.limit(0)).count() == 0


def test_query(spark, sample, odd, none):
    docs = sample.unionByName(odd).withColumn("slot", F.lit("x"))
    got = h.query(spark, docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sizes = check(got, 24)
    assert len(got) == docs.count() and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    for r in got:
        b = texts[r.doc_id].encode()
        assert r.doc_id in (1, 2, 3, 4, 5, 6, 7, 8, 9, None) or (r.size, r.text_crc32) == (len(b) + 8, zlib.crc32(b))
    assert sum(sizes) == sum(len((r.text or "").encode()) + 8 for r in docs.collect())
    assert h.query(spark, none).count() == 0


def test_native(spark, sample):
    assert "Python" not in h.query(spark, sample)._jdf.queryExecution().executedPlan().toString()


def test_thousands_of_cuts(spark):
    """The plan doesn't grow with the cuts, so neither does the time to make it."""
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_013).alias("doc_id"), (F.col("id") % 13 + 1).alias("size"))
    got = h.shard_by_bytes(df, shards=24, rows_per_task=12)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    sizes = check(got.collect(), 24)
    assert max(sizes) - min(sizes) < 60
