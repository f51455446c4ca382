import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from voltaic.functions import geo, stats, text, time


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def square(x0, y0, x1, y1):
    return [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


SHAPE = "array<array<array<struct<x:double,y:double>>>>"


@pytest.mark.parametrize("day,he,utc", [("2026-07-15", 14, "2026-07-15 18:00:00"), ("2026-01-15", 1, "2026-01-15 05:00:00"), ("2026-03-08", 25, "2026-03-09 05:00:00")])
def test_hour_ending_is_fixed_offset(spark, day, he, utc):
    assert str(one(spark, time.hour_ending_utc(F.lit(day), F.lit(he)))) == utc


@pytest.mark.parametrize("day", ["2026-03-08", "2026-11-01"])
def test_clock_changes_leave_24_instants(spark, day):
    hours = spark.range(1, 25).select(time.hour_ending_utc(F.lit(day), F.col("id")).alias("t"))
    assert hours.distinct().count() == 24


@pytest.mark.parametrize("he", [0, 26, None])
def test_bad_hours_fail(spark, he):
    with pytest.raises(Exception, match="hour ending out of range"):
        one(spark, time.hour_ending_utc(F.lit("2026-07-15"), F.lit(he).cast("int")))


def test_null_dates_stay_null(spark):
    assert one(spark, time.hour_ending_utc(F.lit(None).cast("string"), F.lit(3))) is None


def test_wall_clock_and_day_type(spark):
    rows = spark.createDataFrame([("2026-07-20 17:00:00",), ("2026-07-18 17:00:00",), ("2026-09-07 16:00:00",), ("2026-01-15 13:00:00",)], "t string").select(F.to_timestamp("t").alias("timestamp_utc"))
    got = time.with_wall_clock(rows, "timestamp_utc", time.holiday_table(spark, range(2026, 2027))).orderBy("timestamp_utc").collect()
    assert [(r["local_hour"], r["season"], r["day_type"]) for r in got] == [(8, "winter", "weekday"), (13, "summer", "weekend_holiday"), (13, "summer", "weekday"), (12, "summer", "weekend_holiday")]


def test_holidays_of_2026():
    assert sorted(d.isoformat() for d in time.price_holidays(2026).values()) == ["2026-01-01", "2026-02-16", "2026-04-03", "2026-05-18", "2026-07-01", "2026-09-07", "2026-10-12", "2026-12-25", "2026-12-26"]
    assert time.price_holidays(2026, civic=True)["Civic Holiday"] == dt.date(2026, 8, 3)
    assert time.price_holidays(2026, shift_weekends=True)["Boxing Day"] == dt.date(2026, 12, 28)


@pytest.mark.parametrize("year,day", [(2024, "2024-03-31"), (2025, "2025-04-20"), (2026, "2026-04-05"), (2038, "2038-04-25"), (1961, "1961-04-02"), (2000, "2000-04-23")])
def test_easter(year, day):
    assert time.easter(year).isoformat() == day


def test_victoria_day_is_before_the_25th():
    for year in range(2000, 2060):
        day = time.price_holidays(year)["Victoria Day"]
        assert day.weekday() == 0 and 18 <= day.day <= 24


@pytest.mark.parametrize("value,want", [("1,234.5", 1234.5), (" ", 0.0), (None, 0.0), ("12", 12.0)])
def test_number(spark, value, want):
    assert one(spark, text.number(F.lit(value).cast("string"))) == want


def test_number_fails_on_garbage(spark):
    with pytest.raises(Exception):
        one(spark, text.number(F.lit("n/a")))


@pytest.mark.parametrize(
    "node,kind",
    [("A:LMP", "bus"), ("PLAIN", "load"), ("X-LT.BATT1", "battery"), ("FOOSTRGE-LT.T1", "battery"), ("X-LT.STRG", "battery"), ("X_LT.B_DRA", "dra"), ("X-LT.G1", "generator"), ("X-LT.SG12A", "generator"), ("X-LT.G861_A1", "generator"), ("X-LT.GX", "load"), ("X-LT.AG1", "aggregate"), ("X-LT.APG", "aggregate"), ("X-LT.T1_LF", "load")],
)
def test_node_types(spark, node, kind):
    assert one(spark, text.node_type(F.lit(node))) == kind


def test_stems_and_bases(spark):
    stem = lambda x: one(spark, text.name_stem(F.lit(x)))
    assert stem("NORTHBAY-LT.T1") == stem("NORTHBAYGS-LT.G1") == "NORTHBAY"
    base = lambda x: one(spark, text.station_base(F.lit(x)))
    assert (base("ARLEN MTS"), base("BRUCE A TS"), base("LEE DS")) == ("ARLEN", "BRUCEA", "LEEDS")
    node = lambda x: one(spark, text.node_base(F.lit(x)))
    assert (node("BRUCEA-LT.G1"), node("ALPHA.T1"), node("PLAIN")) == ("BRUCEA", "ALPHA", "PLAIN")


def test_names(spark):
    assert one(spark, text.norm(F.lit("  A  b\tC "))) == "a b c"
    assert one(spark, text.without_parenthesis(F.lit("Grid (Formerly Energy+ Inc.) "))) == "Grid"
    assert text.column_name("Non-Exporting Storage") == "non_exporting_storage"


def test_clip(spark):
    assert tuple(stats.clip_range(spark.range(101).select(F.col("id").cast("double").alias("v")), "v").first()) == (2.0, 98.0)
    lo, hi = stats.clip_range(spark.range(5).select(F.lit(3.0).alias("v")), "v").first()
    assert lo == 3.0 and hi > lo
    assert tuple(stats.clip_range(spark.range(0).select(F.lit(1.0).alias("v")), "v").first()) == (0.0, 1.0)
    assert tuple(stats.clip_range(spark.createDataFrame([(1.0,), (None,), (float("nan"),), (2.0,)], "v double"), "v").first()) == pytest.approx((1.02, 1.98))
    assert stats.centred_mid(-1, 1) == 0.0 and stats.centred_mid(1, 2) is None


def test_spearman_matches_pandas(spark):
    pd = pytest.importorskip("pandas")
    x = [3.0, 1.0, 2.0, 2.0, 5.0, 8.0, None, 1.0]
    y = [1.0, 2.0, 2.0, 3.0, 9.0, 7.0, 4.0, float("nan")]
    rho, n = stats.spearman(spark.createDataFrame(list(zip(x, y)), "x double, y double"), "x", "y").first()
    own = pd.DataFrame({"x": x, "y": y}).dropna().rank()
    assert n == 6 and rho == pytest.approx(own.x.corr(own.y), abs=1e-12)
    assert stats.spearman(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), "x", "y").first()[0] is None


def test_coverage_gaps(spark):
    rows = [(d,) for d, n in (("2026-01-01", 4), ("2026-01-02", 1), ("2026-01-04", 4), ("2026-01-05", 4)) for _ in range(n)]
    got = stats.coverage_gaps(spark.createDataFrame(rows, "d string"), "d").orderBy("day").collect()
    assert [(str(r.day), r.n, r.status) for r in got] == [("2026-01-02", 1, "partial"), ("2026-01-03", 0, "missing")]
    assert stats.history_length(24 * 61, dt.date(2026, 1, 1))["months"] == 2.0


def test_point_in_polygon_edges_and_holes(spark):
    shape = [[square(0, 0, 10, 10), square(4, 4, 6, 6)]]
    points = [(5.0, 5.0, False), (4.0, 5.0, True), (0.0, 0.0, True), (10.0, 3.0, True), (1.0, 1.0, True), (11.0, 5.0, False), (5.0, 10.0, True), (-1.0, 0.0, False)]
    df = spark.createDataFrame([(shape, x, y, w) for x, y, w in points], f"g {SHAPE}, x double, y double, want boolean")
    got = df.select("want", geo.covers(F.col("g"), F.col("x"), F.col("y")).alias("got")).collect()
    assert [r.want for r in got] == [r.got for r in got]


def test_distance_area_problems(spark):
    df = spark.createDataFrame([([[square(0, 0, 10, 10), square(4, 4, 6, 6)]],)], f"g {SHAPE}")
    r = df.select(geo.area(F.col("g")).alias("a"), geo.distance(F.col("g"), F.lit(13.0), F.lit(14.0)).alias("d"), geo.distance(F.col("g"), F.lit(5.0), F.lit(5.5)).alias("h"), geo.problems(F.col("g")).alias("p"), geo.bounds(F.col("g")).alias("b")).first()
    assert (r.a, r.d, r.h, r.p, tuple(r.b)) == (96.0, 5.0, 0.5, [], (0.0, 0.0, 10.0, 10.0))
    bad = spark.createDataFrame([([[square(0, 0, 1, 1)[:3]]],)], f"g {SHAPE}").select(geo.problems(F.col("g"))).first()[0]
    assert "ring of fewer than four points" in bad


def test_tidy_and_simplify(spark):
    ring = [{"x": float(i), "y": 0.00001 * (i % 2)} for i in range(10)] + [{"x": 9.0, "y": 9.0}, {"x": 0.0, "y": 9.0}, {"x": 0.0, "y": 0.0}]
    df = spark.createDataFrame([([[ring]],)], f"g {SHAPE}").select(geo.simplify(F.col("g"), 0.1).alias("s"), geo.tidy(F.col("g")).alias("t")).first()
    assert len(df.s[0][0]) == 5 and len(df.t[0][0]) == 13


def test_projection_round_trip_and_scale(spark):
    places = spark.createDataFrame([(-79.387, 43.642), (-75.697, 45.421), (-89.246, 48.38), (-85.0, 44.5)], "lon double, lat double")
    p = places.withColumn("p", geo.project(F.col("lon"), F.col("lat"))).withColumn("q", geo.unproject(F.col("p.x"), F.col("p.y")))
    rows = p.collect()
    for r in rows:
        assert (r.q.lon, r.q.lat) == pytest.approx((r.lon, r.lat), abs=1e-9)
    toronto, ottawa = rows[0], rows[1]
    flat = math.dist((toronto.p.x, toronto.p.y), (ottawa.p.x, ottawa.p.y)) / 1000
    round_ = one(spark, geo.haversine_km(F.lit(toronto.lon), F.lit(toronto.lat), F.lit(ottawa.lon), F.lit(ottawa.lat)))
    assert flat == pytest.approx(round_, rel=0.005)
