"""Sharding by histogram sort: exact bytes below candidate boundaries, refined until they meet a tolerance, then one exchange.

Only DataFrame functions; no Python on the executors.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import durable, free_name

#: Probes in each bracket and pass. Each pass narrows every bracket by this factor, so 64-bit keys take 11 passes at most.
PROBES = 64


LONGS = range(-(2**63), 2**63)


def _number(x: int) -> Column:
    return F.lit(x).cast("long") if x in LONGS else F.lit(str(x)).cast("decimal(20,0)")


def _array(values: list[int], wide: bool) -> Column:
    """Whole numbers as one constant, of longs or of what longs can't hold."""
    if not wide:
        return F.expr(f"array({', '.join(f'{x}L' if x > -(2**63) else 'bigint(-9223372036854775807L) - 1L' for x in values)})")
    return F.expr(f"array({', '.join(f'cast({x}BD as decimal(20,0))' for x in values)})")


def _passed(n: int, passes: Callable[[Column], Column]) -> Column:
    """How many of n items in order, from 0, pass; those that do come first. A binary search, so the plan is the same for any n."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda done, step: F.when((done + step <= n) & passes(done + step - 1), done + step).otherwise(done))


def _refine(rows: DataFrame, key: str, weight: str, brackets: list[tuple[int, int, int, int]], targets: list[float], tolerance: float, within: str | None = None, of: list[int] | None = None) -> list[tuple[int, int]]:
    """For each target the boundary nearest to it and the weight below that.

    A boundary is a key; what lies below it is smaller than the key. brackets: per target a key, the weight below it, a
    larger key, the weight below that. within, of: the target's rows are those whose column `within` has its value.
    Each pass is one aggregation with a row for each probe; the driver gets those sums only.
    """
    of = of or [0] * len(targets)
    done: list[tuple[int, int] | None] = [None] * len(targets)
    while True:
        for i, (a, wa, b, wb) in enumerate(brackets):
            if done[i] is None:
                near, w = (a, wa) if abs(wa - targets[i]) <= abs(wb - targets[i]) else (b, wb)
                if abs(w - targets[i]) <= tolerance or b - a <= 1:
                    done[i] = (near, w)
        ask = sorted({(of[i], *brackets[i]) for i, x in enumerate(done) if x is None})
        if not ask:
            return done  # type: ignore[return-value]
        wide = not all(a in LONGS and b - a in LONGS and b in LONGS for _, a, _, b, _ in ask)
        steps = [-(-(b - a) // PROBES) for _, a, _, b, _ in ask]
        kind = "decimal(20,0)" if wide else "long"
        own = rows.select(F.col(key).cast(kind).alias("key_"), F.col(weight).alias("weight_"), (F.lit(0) if within is None else F.col(within)).cast("decimal(20,0)").alias("of_"))
        low, groups = _array([a for _, a, _, _, _ in ask], wide), _array([g for g, _, _, _, _ in ask], True)
        reached = lambda i: F.get(low, i) <= F.col("key_")
        if within is not None:
            reached = lambda i: (F.get(groups, i) < F.col("of_")) | ((F.get(groups, i) == F.col("of_")) & (F.get(low, i) <= F.col("key_")))
        own = own.withColumn("at_", _passed(len(ask), reached) - 1)
        inside = (F.col("at_") >= 0) & (F.col("key_") < F.get(_array([b for _, _, _, b, _ in ask], wide), F.col("at_"))) & (F.get(groups, F.col("at_")) == F.col("of_"))
        own = own.where(inside).withColumn("from_", F.get(low, F.col("at_"))).withColumn("step_", F.get(_array(steps, wide), F.col("at_")))
        cell = F.expr("(key_ - from_) div step_").cast("long") + F.col("at_").cast("long") * (PROBES + 1)
        sums = {r[0]: int(r[1]) for r in own.groupBy(cell.alias("cell")).agg(F.sum("weight_")).collect()}
        finer = {}
        for n, (group, a, wa, b, wb) in enumerate(ask):
            step = -(-(b - a) // PROBES)
            keys, below = [a], [wa]
            for j in range(PROBES):
                keys.append(min(b, a + step * (j + 1)))
                below.append(below[-1] + sums.get(n * (PROBES + 1) + j, 0))
            finer[(group, a, wa, b, wb)] = (keys, below)
        for i, x in enumerate(done):
            if x is None:
                keys, below = finer[(of[i], *brackets[i])]
                j = min(max(bisect_right(below, targets[i]) - 1, 0), len(keys) - 2)
                while keys[j + 1] <= keys[j] and j:
                    j -= 1
                brackets[i] = (keys[j], below[j], keys[j + 1], below[j + 1])


def _cuts_inside(rows: DataFrame, key: str, row: str, weight: str, found: list[tuple[int, int]], missed: list[int], aims: list[float], last: int, tolerance: float) -> dict[int, tuple[int, int]]:
    """For the targets that no key meets: the key whose rows the boundary cuts apart, and the row where it does.

    That is the key at the boundary, or the one just below it. All of them together take three aggregations and the passes.
    """
    high = sorted({found[i][0] for i in missed if found[i][1] >= aims[i]})
    below, most = {}, None
    if high:
        wide = not all(x in LONGS for x in high) or rows.schema[key].dataType != LongType()
        bounds = _array(high, wide)
        up_to = _passed(len(high), lambda i: F.get(bounds, i) <= F.col(key))
        tops = dict(rows.select(up_to.alias("n"), key).groupBy("n").agg(F.max(key)).collect())
        for n, x in enumerate(high):
            most = max((y for y in (most, tops.get(n)) if y is not None), default=None)
            below[x] = most
    inside = {i: found[i][0] if found[i][1] < aims[i] else int(below[found[i][0]]) for i in missed}
    own = rows.where(F.col(key).isin(*[_number(x) for x in sorted(set(inside.values()))]))
    mass = {int(r[0]): int(r[1]) for r in own.groupBy(key).agg(F.sum(weight)).collect()}
    before = {i: found[i][1] - (0 if found[i][1] < aims[i] else mass[inside[i]]) for i in missed}
    cuts = _refine(own, row, weight, [(0, 0, last + 1, mass[inside[i]]) for i in missed], [aims[i] - before[i] for i in missed], tolerance, key, [inside[i] for i in missed])
    return {i: (inside[i], at) for i, (at, _) in zip(missed, cuts)}


def shard_by_bytes(df: DataFrame, key: str = "doc_id", weight: str = "size", shards: int = 24, tolerance: float = 0.001, rows_per_task: int = 20_000_000) -> DataFrame:
    """df in `shards` key ranges of nearly equal weight, with `shard` int and `slot` long, gapless from 0 in key order.

    tolerance: the part of a shard's weight by which a boundary may miss. Boundaries come from exact sums
    over all rows; only the sums below the probes reach the driver (64 for each boundary). Rows of one key may
    be cut apart: what a key cannot settle, a row number does, so a key that holds a third of all rows is spread.
    Null keys come first, any long may be a key, null weights count as 0, repeated rows keep a slot each, an empty
    table gives an empty result, and columns called shard or slot are replaced. df is read once and kept as a
    checkpoint; pass the columns that the result needs.
    """
    spark = df.sparkSession
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")])
    k, u, w, cell = (free_name(df, x) for x in ("key_", "row_", "weight_", "cell_"))
    rows = durable(df.withColumn(k, F.col(f"`{key}`").cast("long")).withColumn(u, F.monotonically_increasing_id()).withColumn(w, F.coalesce(F.col(f"`{weight}`").cast("long"), F.lit(0))))
    low, high, total, n, nulls, last = rows.agg(F.min(k), F.max(k), F.sum(w), F.count("*"), F.count("*") - F.count(k), F.max(u)).first()
    if not n:
        return rows.drop(k, u, w).withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    low, high = (0, 0) if low is None else (low, high)
    low -= bool(nulls)
    if low not in LONGS or high + 1 not in LONGS:
        rows = rows.withColumn(k, F.col(k).cast("decimal(20,0)"))
    rows = rows.withColumn(k, F.coalesce(F.col(k), _number(low)))
    if not total:  # no weight at all: rows count instead
        rows, total = rows.withColumn(w, F.lit(1).cast("long")), n
    parts = max(1, -(-n // (shards * rows_per_task)))  # ranges of a shard, so that no task sorts a whole large shard
    cuts = shards * parts
    aims = [total * i / cuts for i in range(1, cuts)]
    slack = tolerance * total / cuts
    found = _refine(rows.select(k, w), k, w, [(low, 0, high + 1, total)] * len(aims), aims, slack)
    missed = [i for i, (_, below) in enumerate(found) if abs(below - aims[i]) > slack]
    inside = _cuts_inside(rows.select(k, u, w), k, u, w, found, missed, aims, last, slack) if missed else {}
    bounds = sorted(inside.get(i, (x[0], -1)) for i, x in enumerate(found))
    wide = rows.schema[k].dataType != LongType() or not all(b in LONGS for b, _ in bounds)
    keys, firsts = _array([b for b, _ in bounds], wide), _array([r for _, r in bounds], False)
    at = _passed(len(bounds), lambda i: (F.get(keys, i) < F.col(k)) | ((F.get(keys, i) == F.col(k)) & (F.get(firsts, i) <= F.col(u))))
    placed = rows.withColumn(cell, at)
    counts = dict(placed.groupBy(cell).count().collect())
    first, start = [], 0
    for c in range(cuts):
        start = 0 if c % parts == 0 else start
        first.append(start)
        start += counts.get(c, 0)
    # One exchange: by range, with its cells in its order.
    slot = F.row_number().over(Window.partitionBy(cell).orderBy(k, u)).cast("long") - F.lit(1)
    if parts > 1:
        slot = slot + F.element_at(F.array(*[F.lit(x).cast("long") for x in first]), F.col(cell) + 1)
    return placed.withColumn("slot", slot.cast("long")).withColumn("shard", F.floor(F.col(cell) / parts).cast("int")).drop(k, u, w, cell)


def query(spark, documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_by_bytes(narrow)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
