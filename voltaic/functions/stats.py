"""Percentile clips, rank correlation, coverage of days; each a plan with one pass over its input or a few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def exact_sum(x: Column, scale: int = 4) -> Column:
    """A sum that doesn't depend on the order of its terms: in decimals of this scale, then a double."""
    return F.sum(x.cast(f"decimal(28,{scale})")).cast("double")


def running_counts(df: DataFrame, value: str) -> DataFrame:
    """value, n_, upto_: rows of each distinct value, and of it and all smaller ones, at any size.

    The window over all rows holds one row per range of distinct values, not one per row.
    """
    counts = checkpointed(df.groupBy(value).agg(F.count("*").alias("n_")).repartitionByRange(F.col(value)).withColumn("part_", F.spark_partition_id()))
    inside = F.sum("n_").over(Window.partitionBy("part_").orderBy(value))
    parts = counts.groupBy("part_").agg(F.sum("n_").alias("all_"))
    ahead = parts.select("part_", (F.sum("all_").over(Window.orderBy("part_")) - F.col("all_")).alias("before_"))
    return counts.withColumn("inside_", inside).join(ahead, "part_").select(value, "n_", (F.col("before_") + F.col("inside_")).alias("upto_"))


def clip_range(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """lo, hi: percentiles by linear interpolation; the extremes where they coincide; (0, 1) for no values. NaN and null don't count."""
    x = F.when(~F.isnan(value), F.col(value))
    placed = running_counts(df.select(x.alias("x_")).where("x_ is not null"), "x_")
    total = placed.agg((F.sum("n_") - 1).alias("last_"))
    points = {"lo": F.col("last_") * F.lit(low), "hi": F.col("last_") * F.lit(high)}
    at = lambda rank: F.min(F.when(F.col("upto_") > rank, F.col("x_")))
    ends = [e.alias(f"{k}{i}") for k, p in points.items() for i, e in enumerate((at(F.floor(p)), at(F.ceil(p)), F.max(p - F.floor(p))))]
    cut = placed.crossJoin(F.broadcast(total)).agg(*ends, F.min("x_").alias("least"), F.max("x_").alias("most"))  # total is one row
    lo, hi = (F.col(f"{k}0") * (1 - F.col(f"{k}2")) + F.col(f"{k}1") * F.col(f"{k}2") for k in points)
    flat = lo >= hi
    lo, hi = F.when(flat, F.col("least")).otherwise(lo), F.when(flat, F.col("most")).otherwise(hi)
    hi = F.when(lo >= hi, lo + 1e-6).otherwise(hi)
    return cut.select(F.coalesce(lo, F.lit(0.0)).alias("lo"), F.coalesce(hi, F.lit(1.0)).alias("hi"))


def centred_mid(lo: float, hi: float) -> float | None:
    """0 where a colour scale crosses it, else no centre."""
    return 0.0 if lo < 0 < hi else None


def average_rank(value: str, partition: list[str] | None = None) -> Column:
    """Ranks from 1, ties sharing their mean. Without a partition all rows meet in one task: for reports' tables."""
    keys = partition or []
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def ranked(df: DataFrame, value: str, rank: str) -> DataFrame:
    """df with average ranks over all rows, at any size: values are counted first, ranges of values carry running counts."""
    placed = running_counts(df, value)
    return df.join(placed.select(value, (F.col("upto_") - (F.col("n_") - 1) / 2).alias(rank)), value)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho, n: Pearson's correlation of average ranks over rows with both values; null for fewer than two or constant ranks.

    The sums are of halves, so they are exact and don't depend on order.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(F.col(x).alias("x_"), F.col(y).alias("y_"))
    r = ranked(ranked(both, "x_", "rx_"), "y_", "ry_").select((F.col("rx_") * 2).cast("decimal(19,0)").alias("a"), (F.col("ry_") * 2).cast("decimal(19,0)").alias("b"))
    s = r.agg(F.count("*").alias("n"), *[F.sum(e).cast("double").alias(k) for k, e in {"sa": F.col("a"), "sb": F.col("b"), "saa": F.col("a") * F.col("a"), "sbb": F.col("b") * F.col("b"), "sab": F.col("a") * F.col("b")}.items()])
    spread = (F.col("n") * F.col("saa") - F.col("sa") * F.col("sa")) * (F.col("n") * F.col("sbb") - F.col("sb") * F.col("sb"))
    return s.select(F.when(spread > 0, (F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(spread)).alias("rho"), "n")


def coverage_gaps(df: DataFrame, day: str, share: float = 0.5, most_days: int = 40_000) -> DataFrame:
    """day, n, status: days of df's range that are missing, or partial (fewer rows than share of the median day's).

    A range of more than most_days fails: a stray date, not a gap, makes it that long.
    """
    per = df.groupBy(F.col(day).cast("date").alias("day")).agg(F.count("*").alias("n"))
    facts = per.agg(F.median("n").alias("median"), F.min("day").alias("first"), F.max("day").alias("last"))
    last = F.when(F.date_diff("last", "first") <= most_days, F.col("last")).otherwise(F.when(F.col("last").isNotNull(), F.raise_error(F.lit(f"days further apart than {most_days}")).cast("date")))
    days = facts.select("median", F.explode(F.sequence(F.col("first"), last)).alias("day"))
    out = days.join(per, "day", "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") < share * F.col("median"), "partial")
    return out.select("day", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status")).where("status is not null")


def history_length(hours: int, first) -> dict:
    """Hours as days and months (a month is 30.44 days), and the first date with twelve months of history."""
    import datetime as dt

    days = hours / 24
    return {"days": days, "months": round(days / 30.44, 1), "full_year_from": first + dt.timedelta(days=365)}
