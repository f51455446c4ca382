"""The hourly value join: price, adjustment and fuel mix on the UTC hour, wedges against tariffs, their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import local, with_wall_clock
from . import tariff

KEY = "timestamp_utc"


def unmatched(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """One row: matched, dropped. Keys of one side only are dropped from everything, and counted here."""
    a, b = (t.select(key).distinct() for t in (left, right))
    both = a.withColumn("a_", F.lit(1)).join(b.withColumn("b_", F.lit(1)), key, "full")
    matched = F.col("a_").isNotNull() & F.col("b_").isNotNull()
    return both.agg(F.count_if(matched).alias("matched"), F.count_if(~matched).alias("dropped"))


def hourly(zonal: DataFrame, adjustment: DataFrame, fuel: DataFrame, tariffs: DataFrame, holidays: DataFrame, solar: str = "solar", plans: list[str] | None = None) -> DataFrame:
    """A row per hour that zonal(timestamp_utc, price) and adjustment(timestamp_utc, rate) share.

    energy_price is their sum; fuel's columns of MW give solar_mw and solar_share (null where nothing runs); each plan
    gives <plan>_period, <plan>_offset ($/MWh) and <plan>_wedge, null where no tariff is in force.
    tariffs have passed tariff.validate(); plans: the columns' plans, read from tariffs if not given.
    """
    fuels = [c for c in fuel.columns if c != KEY]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in fuels), F.lit(0.0))
    mix = fuel.select(KEY, (F.coalesce(F.col(solar), F.lit(0.0)) if solar in fuels else F.lit(0.0)).alias("solar_mw"), total.alias("total_"))
    base = zonal.join(adjustment, KEY).join(mix, KEY, "left").withColumn("energy_price", F.col("price") + F.col("rate"))
    base = base.withColumn("solar_mw", F.coalesce("solar_mw", F.lit(0.0))).withColumn("solar_share", F.when(F.col("total_") > 0, F.col("solar_mw") / F.col("total_"))).drop("total_")
    clock = with_wall_clock(base, KEY, holidays)
    if plans is None:
        plans = [r[0] for r in tariffs.select("plan").distinct().orderBy("plan").collect()]  # a plan per column
    out = clock
    for p in plans:
        low = p.lower()
        out = tariff.in_force(out, tariffs, p).withColumnRenamed("period_", f"{low}_period").withColumn(f"{low}_offset", F.col("cents_") * 10).drop("cents_")
        out = out.withColumn(f"{low}_wedge", F.col(f"{low}_offset") - F.col("energy_price"))
    return out


def summary(values: DataFrame, wedge: str = "tou_wedge", digits: int = 4) -> DataFrame:
    """One row: window, hours, coverage of the window in percent, and means of hourly values rounded first, as published."""
    span = (F.unix_timestamp(F.max(KEY)) - F.unix_timestamp(F.min(KEY))) / 3600 + 1
    return values.agg(
        F.min(KEY).alias("window_start"), F.max(KEY).alias("window_end"), F.count("*").alias("hours"), (100 * F.count("*") / span).alias("coverage_pct"),
        F.avg(F.bround("energy_price", digits)).alias("mean_energy_price"), F.avg(F.bround(wedge, digits)).alias("mean_wedge"),
    )


def peak_hours(hourly_: DataFrame, value: str, time: str = KEY) -> DataFrame:
    """month, hour: the local hour of the greatest mean per local month; of equal means the earliest."""
    clock = local(F.col(time))
    mean = hourly_.where(F.col(value).isNotNull()).groupBy(F.date_format(clock, "yyyy-MM").alias("month"), F.hour(clock).alias("hour")).agg((F.sum(F.col(value).cast("decimal(28,4)")).cast("double") / F.count("*")).alias("mean"))
    return mean.groupBy("month").agg(F.max_by("hour", F.struct("mean", (-F.col("hour")).alias("early"))).alias("hour"), F.max("mean").alias("mean"))


def check_solar_peak(hourly_: DataFrame, value: str, first: int = 12, last: int = 14) -> DataFrame:
    """The peak hours, or ValueError if a month's lies outside; that means that hours are labelled wrongly."""
    peaks = peak_hours(hourly_, value)
    if bad := peaks.where(~F.col("hour").between(first, last)).orderBy("month").collect():
        raise ValueError(f"solar output peaks outside {first} to {last} h: {[tuple(r) for r in bad]}")
    return peaks


def period_table(values: DataFrame, plan: str) -> DataFrame:
    """Mean wedge and number of hours by period of a plan; hours without a period don't count."""
    return values.where(F.col(f"{plan}_period").isNotNull()).groupBy(F.col(f"{plan}_period").alias("period")).agg(F.avg(f"{plan}_wedge").alias("mean_wedge"), F.count("*").alias("hours"))


def annual_gap(values: DataFrame, plan: str = "tou", days: int = 365) -> DataFrame:
    """One row: hours, gap. The share of solar output's value at the plan's price that the market price doesn't pay.

    Only hours with a price in force count; gap is null until they cover so many days, and where nothing is produced.
    """
    own = values.where(F.col(f"{plan}_offset").isNotNull())
    paid = F.sum(F.col("solar_mw") * F.col(f"{plan}_offset"))
    missed = F.sum(F.col("solar_mw") * (F.col(f"{plan}_offset") - F.col("energy_price")))
    return own.agg(F.count("*").alias("hours"), F.when((F.count("*") >= 24 * days) & (paid != 0), missed / paid).alias("gap"))
