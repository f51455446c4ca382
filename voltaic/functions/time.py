"""The hour-ending time model: fixed UTC-5 market hours in, UTC instants stored, local wall clock derived."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKET_OFFSET_HOURS = 5
LOCAL = "America/Toronto"


def hour_ending_utc(date: Column, hour_ending: Column) -> Column:
    """The instant at which a market hour starts. Labels run from 1 to 25; others fail the query."""
    he = hour_ending.cast("int")
    start = date.cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=he - 1 + MARKET_OFFSET_HOURS)
    bad = he.isNull() | (he < 1) | (he > 25)
    return F.when(date.isNull() | ~bad, start.cast("timestamp")).otherwise(F.raise_error(F.concat(F.lit("hour ending out of range: "), F.coalesce(he.cast("string"), F.lit("null")))).cast("timestamp"))


def local(instant: Column) -> Column:
    """The wall clock at an instant, as a timestamp without zone."""
    return F.from_utc_timestamp(instant.cast("timestamp"), LOCAL).cast("timestamp_ntz")


def season(day: Column) -> Column:
    return F.when(F.month(day).between(5, 10), "summer").otherwise("winter")


def weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7)


def with_wall_clock(df: DataFrame, instant: str, holidays: DataFrame) -> DataFrame:
    """df with local_date, local_hour, season and day_type (weekday or weekend_holiday).

    holidays(date): a row per date, a few dozen a year, so its side of the join stays small at any size of df.
    """
    days = holidays.select(F.col("date").cast("date").alias("holiday_")).distinct()
    clock = local(F.col(instant))
    out = df.withColumn("local_date", clock.cast("date")).withColumn("local_hour", F.hour(clock))
    out = out.join(days, F.col("local_date") == F.col("holiday_"), "left")
    off = weekend(F.col("local_date")) | F.col("holiday_").isNotNull()
    return out.withColumn("season", season(F.col("local_date"))).withColumn("day_type", F.when(off, "weekend_holiday").otherwise("weekday")).drop("holiday_")


def easter(year: int) -> dt.date:
    """Western Easter Sunday, from the golden number, the century's corrections and the epact."""
    golden, century = year % 19 + 1, year // 100 + 1
    dropped, moon = 3 * century // 4 - 12, (8 * century + 5) // 25 - 5
    sunday = 5 * year // 4 - dropped - 10
    epact = (11 * golden + 20 + moon - dropped) % 30
    if epact == 24 or epact == 25 and golden > 11:
        epact += 1
    full = 44 - epact
    full += 30 if full < 21 else 0
    full += 7 - (sunday + full) % 7
    return dt.date(year, 3, 1) + dt.timedelta(days=full - 1)


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    day = dt.date(year, month, 1)
    return day + dt.timedelta(days=(weekday - day.weekday()) % 7 + 7 * (n - 1))


def price_holidays(year: int, civic: bool = False, shift_weekends: bool = False) -> dict[str, dt.date]:
    """The nine holidays on which prices are off peak all day; the August civic holiday is optional."""
    before_25_may = dt.date(year, 5, 24)
    days = {
        "New Year's Day": dt.date(year, 1, 1),
        "Family Day": _nth(year, 2, 0, 3),
        "Good Friday": easter(year) - dt.timedelta(days=2),
        "Victoria Day": before_25_may - dt.timedelta(days=before_25_may.weekday()),
        "Canada Day": dt.date(year, 7, 1),
        "Labour Day": _nth(year, 9, 0, 1),
        "Thanksgiving Day": _nth(year, 10, 0, 2),
        "Christmas Day": dt.date(year, 12, 25),
        "Boxing Day": dt.date(year, 12, 26),
    }
    if civic:
        days["Civic Holiday"] = _nth(year, 8, 0, 1)
    if shift_weekends:
        days = {k: d + dt.timedelta(days=max(0, 7 - d.weekday()) if d.weekday() > 4 else 0) for k, d in days.items()}
    return days


def holiday_table(spark: SparkSession, years: range, **options: bool) -> DataFrame:
    rows = [(day, name) for year in years for name, day in price_holidays(year, **options).items()]
    return spark.createDataFrame(rows, "date date, name string")
