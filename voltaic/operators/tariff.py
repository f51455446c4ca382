"""Effective-dated tariffs: validation, and the interval join as an equi-join on hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = ["effective_from", "plan", "season", "day_type"]


def validate(tariffs: DataFrame) -> DataFrame:
    """The tariffs, or ValueError: each block must cover 24 hours exactly once and terms must not overlap.

    A stricter check than a sum of lengths, which a gap and an overlap of the same length would pass. Tariffs are some
    dozens of rows; what is wrong with them comes to the driver.
    """
    hours = expand_hours(tariffs).groupBy(*BLOCK, "hour").count().where("count > 1").limit(5).collect()
    sums = tariffs.groupBy(*BLOCK).agg(F.sum(F.col("end_hour") - F.col("start_hour")).alias("hours")).where("hours <> 24").limit(5).collect()
    if hours or sums:
        raise ValueError(f"tariff blocks don't cover 24 hours once: {[tuple(r) for r in [*sums, *hours]]}")
    term = Window.orderBy("effective_from")
    terms = tariffs.select("effective_from", "effective_to").distinct().withColumn("before", F.lag("effective_to").over(term))
    if bad := terms.where(F.col("effective_from") <= F.col("before")).limit(5).collect():
        raise ValueError(f"tariff terms overlap: {[tuple(r) for r in bad]}")
    return tariffs


def expand_hours(tariffs: DataFrame) -> DataFrame:
    """A row per hour of each block (end_hour is exclusive)."""
    whole = tariffs.where(F.col("start_hour") < F.col("end_hour"))
    return whole.withColumn("hour", F.explode(F.sequence(F.col("start_hour"), F.col("end_hour") - 1)))


def classify(hours: DataFrame, tariffs: DataFrame, last: str | None = None) -> DataFrame:
    """hours(local_date, local_hour, season, day_type) with plan, period and price of each plan in force; hours without one are gone.

    Equal on season, day type and hour; the dates remain as a range on the few terms that match. last: an ordinal of
    tariffs; where several rows match an hour and plan the last wins, as a scan in file order would have it.
    """
    keys = ["season", "day_type", "hour", "plan", "effective_from", "effective_to"]
    rows = expand_hours(tariffs).select(*keys, "period", "commodity_c_per_kwh", *([last] if last else []))
    rows = rows.withColumnsRenamed({"season": "t_season", "day_type": "t_day_type"})
    at = (F.col("season") == F.col("t_season")) & (F.col("day_type") == F.col("t_day_type")) & (F.col("local_hour") == F.col("hour")) & F.col("local_date").between(F.col("effective_from"), F.col("effective_to"))
    out = hours.join(rows, at).drop("t_season", "t_day_type", "hour", "effective_from", "effective_to")
    if not last:
        return out
    best = F.max_by(F.struct("period", "commodity_c_per_kwh"), last).alias("best_")
    return out.groupBy(*hours.columns, "plan").agg(best).select(*hours.columns, "plan", "best_.*")


def in_force(hours: DataFrame, tariffs: DataFrame, plan: str) -> DataFrame:
    """hours(local_date, local_hour, season, day_type) with period_ and cents_ of one plan, null where none is in force.

    tariffs must pass validate(), so that no hour finds two rows; the plan's rows are some dozens, the hours stay where they are.
    """
    own = expand_hours(tariffs.where(F.col("plan") == plan))
    own = own.select(F.col("season").alias("s_"), F.col("day_type").alias("d_"), F.col("hour").alias("h_"), F.col("effective_from").alias("from_"), F.col("effective_to").alias("to_"), F.col("period").alias("period_"), F.col("commodity_c_per_kwh").alias("cents_"))
    at = (F.col("season") == F.col("s_")) & (F.col("day_type") == F.col("d_")) & (F.col("local_hour") == F.col("h_")) & F.col("local_date").between(F.col("from_"), F.col("to_"))
    return hours.join(own, at, "left").drop("s_", "d_", "h_", "from_", "to_")


def ending(tariffs: DataFrame, on: str, days: int = 30) -> DataFrame:
    """plan, last_day: plans whose last term ends within so many days of the date on, or has ended; open terms don't end."""
    last = tariffs.groupBy("plan").agg(F.max(F.to_date("effective_to")).alias("last_day"), F.count_if(F.col("effective_to").isNull()).alias("open_"))
    return last.where((F.col("open_") == 0) & (F.col("last_day") <= F.date_add(F.to_date(F.lit(on)), days))).select("plan", "last_day")
