"""Nodal prices: matched-hour daily compaction, hour-weighted windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import exact_sum


def compact_daily(hourly: DataFrame, zonal: DataFrame, keys: tuple[str, ...] = ("node_id", "date"), time: str = "timestamp_utc") -> DataFrame:
    """Per key the means over matched hours of price less zonal price, of loss and of congestion, and n_hours.

    An hour counts if both prices are there; its missing loss or congestion adds 0 and still counts. Partial sums form
    before the shuffle. The sums stay as columns (sum_..), for windows that weigh by hours without rounding twice.
    """
    ref = zonal.select(F.col(time).alias("time_"), F.col("price").alias("zonal_")).where("zonal_ is not null")
    both = hourly.where(F.col("lmp").isNotNull()).join(ref, F.col(time) == F.col("time_"))
    gap = F.col("lmp").cast("decimal(18,4)") - F.col("zonal_").cast("decimal(18,4)")
    out = both.groupBy(*keys).agg(
        exact_sum(gap).alias("sum_lmp_minus_ozp"), exact_sum(F.coalesce("loss", F.lit(0.0))).alias("sum_loss"), exact_sum(F.coalesce("congestion", F.lit(0.0))).alias("sum_congestion"), F.count("*").cast("int").alias("n_hours")
    )
    means = [(F.col(f"sum_{m}") / F.col("n_hours")).alias(f"mean_{m}") for m in ("lmp_minus_ozp", "loss", "congestion")]
    return out.select(*keys, *means, "n_hours", "sum_lmp_minus_ozp", "sum_loss", "sum_congestion")


def window_means(daily: DataFrame, zonal_daily: DataFrame | None = None, days: int = 32, least_days: int = 15) -> DataFrame:
    """Per node over the `days` up to the last date of all: n_days, hours, hour-weighted means, kept.

    kept: the node has least_days different dates or more. zonal_daily(date, price) adds mean_lmp: a day without a
    zonal price adds nothing to it while its hours stay in the divisor, as published; known_hours has them apart.
    """
    last = daily.agg(F.max("date").alias("last_"))
    own = daily.crossJoin(F.broadcast(last)).where(F.col("date") > F.date_sub("last_", days)).drop("last_")  # one row
    parts = {m: F.col(f"sum_{m}") if f"sum_{m}" in daily.columns else F.col(f"mean_{m}") * F.col("n_hours") for m in ("lmp_minus_ozp", "loss", "congestion")}
    aggs = [(exact_sum(p, 8) / F.sum("n_hours")).alias(n) for n, p in zip(("mean_premium", "mean_loss", "mean_congestion"), parts.values())]
    if zonal_daily is not None:
        own = own.join(zonal_daily.select("date", F.col("price").alias("zonal_")), "date", "left")
        priced = F.col("zonal_").isNotNull()
        aggs += [(exact_sum(F.when(priced, parts["lmp_minus_ozp"] + F.col("zonal_") * F.col("n_hours")), 8) / F.sum("n_hours")).alias("mean_lmp"), F.sum(F.when(priced, F.col("n_hours")).otherwise(0)).alias("known_hours")]
    out = own.groupBy("node_id").agg(F.count_distinct("date").alias("n_days"), F.sum("n_hours").alias("hours"), *aggs)
    return out.withColumn("kept", F.col("n_days") >= least_days)
