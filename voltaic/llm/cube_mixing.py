"""Mixing sources to target weights by the cube method.

A source whose target is r times its size takes every document floor(r) times, and each once more with
probability r - floor(r). The cube method settles those fractional probabilities: its flight phase moves them
through the null space of the constraints (each source's number of documents and of words), so both totals hold
all the way, until fewer documents than constraints are left; the landing settles those few.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable

#: What one of the first sources by code point weighs, in turn.
WEIGHTS = (5, 2, 1)
#: A document settled to within this of 0 or 1 is settled.
EPS = 1e-9
#: Documents of a source that one flight settles at once; about two remain of each such block.
BLOCK = 4096
#: Documents of a source that the last flight leaves for the landing, besides the two that it cannot settle.
HELD = 10


def targets(sizes: DataFrame, total_share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source of sizes(source, size): source, rank_, source_size, target.

    The targets share total_share of all words by weight; one stops at `most` times its source's size and its excess
    is shared again. That fills the sources in order of size per weight, so one pass over their running sums settles
    it: the level is the first at which no further source is full. The window holds a row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank_", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank_") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight_", weight).withColumn("cap_", F.col("source_size") * F.lit(most))
    fill = Window.orderBy(F.col("cap_") / F.col("weight_"), "rank_")
    everything = Window.partitionBy(F.lit(0))
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(total_share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap_").over(before), F.lit(0.0))) / F.sum("weight_").over(after)
    per = per.withColumn("level_", level)
    # The level at the first source that it does not fill is the final one.
    per = per.withColumn("final_", F.max(F.when(F.col("level_") * F.col("weight_") <= F.col("cap_"), F.col("level_"))).over(everything))
    target = F.when(F.col("final_").isNull(), F.col("cap_")).otherwise(F.least(F.col("cap_"), F.col("final_") * F.col("weight_")))
    return per.select("source", "rank_", "source_size", target.alias("target"))


def flight(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """p after a flight that keeps sum(p) and sum(p * size): each is 0 or 1 but for two at most.

    Three documents at a time have one direction that leaves both totals alone; the step goes to the nearer wall.
    The direction's sign follows the parity of the steps, so reruns agree.
    """
    p = p.astype(float).copy()
    size = size.astype(float)
    live: list[int] = []
    values, sizes = p.tolist(), size.tolist()
    for i in range(len(values)):
        if EPS < values[i] < 1 - EPS:
            live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        if i & 1:
            u = (-u[0], -u[1], -u[2])
        step = min((1 - values[j]) / d if d > 0 else values[j] / -d for j, d in zip(live, u) if d)
        for j, d in zip(live, u):
            values[j] += step * d
        for j in live:
            values[j] = 0.0 if values[j] < EPS else 1.0 if values[j] > 1 - EPS else values[j]
        live = [j for j in live if 0 < values[j] < 1]
    return np.array(values)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The 0/1 choice that misses the word total least, of those that miss the number of documents by less than one."""
    choices = np.array(list(product((0.0, 1.0), repeat=len(p))), float).reshape(2 ** len(p), len(p))
    words = np.abs(choices @ size - p @ size)
    return choices[np.argmin(np.where(np.abs(choices.sum(axis=1) - p.sum()) < 1, words, np.inf))]


def _in_order(group: pa.Table) -> pa.Table:
    return group.sort_by([("order_", "ascending"), ("tie_", "ascending"), ("size", "ascending")])


def _with(group: pa.Table, p: np.ndarray) -> pa.Table:
    return group.set_column(group.schema.get_field_index("p_"), "p_", pa.array(p, pa.float64()))


def _fly(group: pa.Table) -> pa.Table:
    group = _in_order(group)
    return _with(group, flight(group.column("p_").to_numpy(), group.column("size").to_numpy()))


def _land(group: pa.Table) -> pa.Table:
    group = _in_order(group)
    size, p = group.column("size").to_numpy(), group.column("p_").to_numpy().copy()
    # Some documents, spread evenly over the sizes, wait for the landing, which then can meet the totals closely.
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    open_ = open_[np.argsort(size[open_], kind="stable")]
    held = open_[np.unique(np.linspace(0, len(open_) - 1, HELD).astype(int))] if len(open_) else open_
    flying = np.ones(len(p), bool)
    flying[held] = False
    p[flying] = flight(p[flying], size[flying])
    left = (p > 0) & (p < 1)
    p[left] = landing(p[left], size[left].astype(float))
    return _with(group, p)


def numbered(rows: DataFrame) -> DataFrame:
    """rows with tie_, a number from 0 among equal rows, the same however rows are partitioned.

    Equal rows are counted before they move; a count becomes rows again in two steps, so that no task makes more than
    its share of a hot one.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n_"))
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_") - 1) / BLOCK))
    spread = counted.select("*", F.explode(runs).alias("run_"))
    last = F.least(F.col("n_"), (F.col("run_") + 1) * BLOCK) - 1
    return spread.withColumn("tie_", F.explode(F.sequence(F.col("run_") * BLOCK, last))).drop("n_", "run_")


def mix(docs: DataFrame, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs(doc_id, source, size): also source_size, target and times, how often the mix takes it; carry: further columns to keep.

    Documents of a source fly in blocks dealt by hash, so a source of a third of all rows takes as many tasks as it
    needs. What remains of the blocks (two documents each) flies again in larger and larger company, down to one block
    per source, which lands. Nulls: a null source is a source, a null doc_id a document; an empty table gives an empty
    result; repeated rows are documents of their own. Reruns agree whatever the partitions: order and blocks come from
    hashes of the rows, and equal rows are numbered among themselves.
    """
    rows = docs.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), *carry)
    rows = durable(numbered(rows))
    goal = targets(rows).select("source", "rank_", "source_size", "target")
    # A row per source: the smaller side by far, but of no proven bound, so AQE picks the join and splits a hot source.
    rows = rows.join(goal.withColumnRenamed("source", "source_of_"), F.col("source").eqNullSafe(F.col("source_of_"))).drop("source_of_")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole_", F.floor(ratio).cast("int")).withColumn("p_", F.when(F.col("size") > 0, ratio - F.floor(ratio)).otherwise(F.lit(0.0)))
    rows = rows.withColumn("order_", F.xxhash64(F.lit(seed), "doc_id", "size", "source", *carry))
    left, settled = rows, None
    most = left.groupBy("rank_").count().agg(F.max("count")).first()[0] or 0
    while most > BLOCK:
        blocks = -(-most // BLOCK)
        dealt = left.withColumn("block_", F.pmod(F.xxhash64("order_", "tie_"), F.lit(blocks)))
        flown = durable(dealt.groupBy("rank_", "block_").applyInArrow(_fly, dealt.schema).drop("block_"))
        fractional = (F.col("p_") > 0) & (F.col("p_") < 1)
        out = flown.where(~fractional)
        settled = out if settled is None else settled.unionByName(out)
        left = flown.where(fractional)
        before, most = most, left.groupBy("rank_").count().agg(F.max("count")).first()[0] or 0
        if most >= before:
            raise RuntimeError("a flight settled nothing")
    landed = left.groupBy("rank_").applyInArrow(_land, left.schema)
    done = landed if settled is None else settled.unionByName(landed)
    return done.select(*carry, "doc_id", "source", "size", "source_size", "target", (F.col("whole_") + F.col("p_").cast("int")).alias("times"))


def sized(documents: DataFrame) -> DataFrame:
    return documents.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def query(spark, documents: DataFrame) -> DataFrame:
    out = mix(sized(documents.select("doc_id", "source", "text")).select("doc_id", "source", "size"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))
