import pytest
from pyspark.sql import functions as F

from voltaic.operators import adoption, decisions, merge, names, nodal, signal, spatial, tariff, value, zones
from voltaic.plans import queries
from voltaic.schemas import POLYGONS


def square(x, y, side=10_000.0):
    return [[[{"x": x + 1.0 * a * side, "y": y + 1.0 * b * side} for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]]]


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_keep_last_and_merge(spark):
    old = spark.createDataFrame([("h1", "A", 50.0), ("h1", "B", 51.0)], "t string, node string, lmp double")
    new = spark.createDataFrame([("h1", "A", 51.5, 1), ("h1", "A", 52.0, 2)], "t string, node string, lmp double, seq int")
    got = merge.merge(old, new, ["t", "node"], "seq")
    assert got.columns == ["t", "node", "lmp", "seq"]
    assert rows(got, "node") == [("h1", "A", 52.0, 2), ("h1", "B", 51.0, None)]
    assert rows(merge.merge(got, new, ["t", "node"], "seq"), "node") == rows(got, "node")
    assert merge.merge(old.limit(0), new.limit(0), ["t", "node"], "seq").count() == 0


def test_winner_files(spark):
    files = spark.createDataFrame([(n,) for n in ("F_20260101_v1.xml", "F_20260101.xml", "F_20260102_v2.xml", "F_20260102_v10.xml", "F.xml")], "name string")
    assert rows(merge.winner_per_date(files), "date") == [("20260101", "F_20260101.xml"), ("20260102", "F_20260102_v10.xml")]
    assert merge.latest_file(files).first()[0] == "F.xml"
    assert merge.latest_file(files.where("name <> 'F.xml'")).first()[0] == "F_20260102_v10.xml"


def test_changed_files(spark):
    now = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 1, 1)], "name string, mtime int, size int")
    before = spark.createDataFrame([("a", 1, 5), ("b", 1, 5)], "name string, mtime int, size int")
    assert rows(merge.changed_files(now, before).select("name"), "name") == [("b",), ("c",)]


def test_tariffs(spark):
    t = queries.tariffs(spark)
    assert tariff.validate(t) is t
    gap = t.where("not (plan = 'TOU' and period = 'mid_peak')")
    with pytest.raises(ValueError, match="24 hours"):
        tariff.validate(gap)
    swapped = t.withColumn("start_hour", F.when((F.col("plan") == "TOU") & (F.col("period") == "mid_peak"), 6).otherwise(F.col("start_hour"))).withColumn("end_hour", F.when((F.col("plan") == "TOU") & (F.col("period") == "mid_peak"), 12).otherwise(F.col("end_hour")))
    with pytest.raises(ValueError, match="24 hours"):  # six hours still, but one twice and one not at all
        tariff.validate(swapped)
    with pytest.raises(ValueError, match="overlap"):
        tariff.validate(t.withColumn("effective_to", F.lit("2024-01-20").cast("date")))


def test_classify_matches_the_interval_join(spark):
    t = queries.tariffs(spark)
    hours = spark.sql("select explode(sequence(timestamp'2024-01-10 05:00:00', timestamp'2024-02-02 05:00:00', interval 1 hour)) as timestamp_utc")
    from voltaic.functions.time import with_wall_clock

    clock = with_wall_clock(hours, "timestamp_utc", queries.holidays(spark))
    got = tariff.classify(clock, t).select("timestamp_utc", "plan", "period", "commodity_c_per_kwh")
    theta = clock.alias("h").join(t.alias("t"), F.expr("h.season = t.season and h.day_type = t.day_type and local_date between effective_from and effective_to and local_hour >= start_hour and local_hour < end_hour"))
    want = theta.select("timestamp_utc", "plan", "period", "commodity_c_per_kwh")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert got.count() == 2 * clock.where("local_date <= date'2024-01-29'").count()


def test_last_tariff_row_wins(spark):
    t = spark.createDataFrame([("2026-01-01", "2026-12-31", "TOU", "winter", p, "weekday", 0, 24, c, i) for i, (p, c) in enumerate((("a", 1.0), ("b", 2.0)))], queries.TARIFF_COLUMNS + ", n int").withColumn("effective_from", F.to_date("effective_from")).withColumn("effective_to", F.to_date("effective_to"))
    hour = spark.sql("select date'2026-01-05' as local_date, 3 as local_hour, 'winter' as season, 'weekday' as day_type")
    assert rows(tariff.classify(hour, t, "n").select("period", "commodity_c_per_kwh")) == [("b", 2.0)]


def test_matched_hours(spark):
    hourly = spark.createDataFrame([("N1", "d", 0, 50.0, 1.0, None), ("N1", "d", 1, 60.0, 9.0, 9.0), ("N2", "d", 0, 70.0, None, 2.0), ("N3", "d", 0, None, 1.0, 1.0), ("N4", "d", 1, 5.0, 1.0, 1.0)], "node_id string, date string, timestamp_utc int, lmp double, loss double, congestion double")
    zonal = spark.createDataFrame([(0, 40.0), (2, 1.0)], "timestamp_utc int, price double")
    got = nodal.compact_daily(hourly, zonal).select("node_id", "mean_lmp_minus_ozp", "mean_loss", "mean_congestion", "n_hours")
    assert rows(got, "node_id") == [("N1", 10.0, 1.0, 0.0, 1), ("N2", 30.0, 0.0, 2.0, 1)]


def test_hour_weighted_window(spark):
    days = [f"2026-09-{d:02d}" for d in range(1, 16)]
    daily = spark.createDataFrame([("A", d, 1.0 if i == 0 else 0.0, 0.0, 0.0, 20 if i == 0 else 24) for i, d in enumerate(days)] + [("B", d, 1.0, 0.0, 0.0, 24) for d in days[:14]], "node_id string, date string, mean_lmp_minus_ozp double, mean_loss double, mean_congestion double, n_hours int").withColumn("date", F.to_date("date"))
    zonal = spark.createDataFrame([(d, 40.0) for d in days[1:]], "date string, price double").withColumn("date", F.to_date("date"))
    got = {r.node_id: r for r in nodal.window_means(daily, zonal).collect()}
    assert got["A"].mean_premium == pytest.approx(20 / 356) and got["A"].kept and not got["B"].kept
    assert got["A"].mean_lmp == pytest.approx(40 * 336 / 356) and got["A"].known_hours == 336
    assert nodal.window_means(daily, days=3).where("node_id = 'B'").first().n_days == 2


def test_value_join(spark):
    z = spark.sql("select timestamp'2024-01-16 17:00:00' + make_dt_interval(0, id) as timestamp_utc, 30.0 + id as price from range(3)")
    a = spark.sql("select timestamp'2024-01-16 17:00:00' + make_dt_interval(0, id) as timestamp_utc, 10.0 as rate from range(1, 4)")
    fuel = spark.sql("select timestamp'2024-01-16 18:00:00' as timestamp_utc, 5.0 as solar, 15.0 as gas, cast(null as double) as wind")
    assert rows(value.unmatched(z, a)) == [(2, 2)]
    got = value.hourly(z, a, fuel, queries.tariffs(spark), queries.holidays(spark)).orderBy("timestamp_utc").collect()
    assert [(r.energy_price, r.solar_mw, r.solar_share, r.tou_period, r.tou_offset) for r in got] == [(41.0, 5.0, 0.25, "mid_peak", 137.0), (42.0, 0.0, None, "mid_peak", 137.0)]
    assert got[0].tou_wedge == 96.0
    s = value.summary(spark.createDataFrame(got)).first()
    assert s.hours == 2 and s.coverage_pct == 100.0 and s.mean_wedge == pytest.approx(95.5)
    assert value.hourly(z.limit(0), a, fuel, queries.tariffs(spark), queries.holidays(spark)).count() == 0


def test_solar_gate(spark):
    at = lambda h: spark.createDataFrame([(f"2026-07-15 {h + 4}:00:00", 9.0), ("2026-07-15 13:00:00", 1.0)], "t string, solar double").select(F.to_timestamp("t").alias("timestamp_utc"), "solar")
    assert value.check_solar_peak(at(12), "solar").first().hour == 12
    with pytest.raises(ValueError, match="peaks outside"):
        value.check_solar_peak(at(11), "solar")


def test_name_cascade(spark):
    current = spark.createDataFrame([("Alpha Power Inc.",), ("Beta Hydro",), ("Gamma",)], "name string")
    historical = spark.createDataFrame([("Old Beta", "Beta Hydro")], "former string, name string")
    asked = [("1", "Alpha Power Inc."), ("2", " ALPHA  power inc. "), ("3", "Beta Hydro (formerly X)"), ("4", "old beta"), ("5", "Beta"), ("6", "Gamma|Beta Hydro"), ("7", "Gamma|Nobody")]
    got = names.cascade(spark.createDataFrame(asked, "licence_no string, utility_name string"), "licence_no", "utility_name", current, historical)
    assert rows(got, "licence_no") == [
        ("1", ["Alpha Power Inc."], "exact_current"), ("2", ["Alpha Power Inc."], "exact_current"), ("3", ["Beta Hydro"], "parenthetical_stripped"), ("4", ["Beta Hydro"], "exact_historical"),
        ("5", [], "unmatched"), ("6", ["Gamma", "Beta Hydro"], "exact_current"), ("7", [], "unmatched"),
    ]


def test_prefix_zones(spark):
    stations = spark.createDataFrame([("WALLACE TS", "EAST"), ("WALLACEBURG TS", "WEST"), ("LEE", "EAST"), ("CUMBER TS", "EAST"), ("CUMBER DS", "WEST")], "station_name string, electrical_zone string")
    nodes = spark.createDataFrame([("WALLACEBURG-LT.T1",), ("WALLACEX-LT.T1",), ("LEE-LT.T1",), ("CUMBER-LT.T2",), ("Q",)], "node_id string")
    got = names.match_zones(nodes, stations).select("node_id", "zone")
    assert rows(got, "node_id") == [("CUMBER-LT.T2", None), ("LEE-LT.T1", None), ("Q", None), ("WALLACEBURG-LT.T1", "WEST"), ("WALLACEX-LT.T1", "EAST")]
    assert zones.coverage(names.match_zones(nodes, stations)) == (0.4, False)


def test_weights_and_overrides(spark):
    inside = spark.createDataFrame([("L1", "A"), ("L1", "A"), ("L1", "B"), ("L2", "B"), ("L2", None)], "licence_no string, zone string")
    w = zones.check_weights(zones.votes(inside, "licence_no", "zone"), "licence_no")
    assert rows(w, "licence_no", "zone") == [("L1", "A", 2, 2 / 3), ("L1", "B", 1, 1 / 3), ("L2", "B", 1, 1.0)]
    over = spark.createDataFrame([("L1", "C", 0.5), ("L1", "D", 0.5)], "licence_no string, zone string, weight double")
    both = zones.check_weights(zones.with_overrides(w, over, "licence_no", "zone"), "licence_no")
    assert rows(both.select("licence_no", "zone", "n_nodes", "method"), "licence_no", "zone") == [("L1", "C", 3, "override"), ("L1", "D", 3, "override"), ("L2", "B", 1, "votes")]
    with pytest.raises(ValueError, match="add up"):
        zones.check_weights(over.where("zone = 'C'"), "licence_no")
    assert rows(zones.primary(w, "licence_no", "zone"), "licence_no") == [("L1", "A"), ("L2", "B")]


def signal_fixture(spark):
    layer = spark.createDataFrame([("ED-A", "A", square(0, 0)), ("ED-B", "B", square(25_000, 0)), ("ED-C", "C", square(500_000, 0)), ("ED-D", "D", square(0, 60_000, 5_000))], f"licence_no string, utility_name string, geometry {POLYGONS}")
    nodes = spark.createDataFrame([("N1", "load", 5_000.0, 5_000.0), ("N2", "aggregate", 6_000.0, 5_000.0), ("N4", "load", 1_000.0, 61_000.0), ("N5", "load", 2_000.0, 61_000.0)], "Location string, node_type string, x double, y double")
    stats = spark.createDataFrame([("N1", 1.0), ("N2", 9.0), ("N4", 0.0), ("N5", 5.0)], "node string, mean_premium double").withColumn("mean_congestion", F.lit(0.0)).withColumn("mean_loss", F.lit(0.0))
    return layer, nodes, stats


def test_signal(spark):
    layer, nodes, stats = signal_fixture(spark)
    got = {r.licence_no: r for r in signal.build(layer, nodes, stats).collect()}
    a, b, c, d = (got[f"ED-{x}"] for x in "ABCD")
    assert (a.n_nodes, a.mean_premium, a.node_types, a.method, a.std_premium, a.heterogeneous) == (1, 1.0, "load:1", "in_polygon", None, False)
    assert (b.method, b.distance_km, b.node_names, b.node_types, b.n_nodes) == ("nearest_within_30km", 20.0, "N1", "load", 1)
    assert (c.method, c.n_nodes, c.mean_premium) == ("none", 0, None)
    assert (d.n_nodes, d.heterogeneous, d.span_km, d.node_names) == (2, True, 1.0, "N4; N5")
    wide = signal.build(layer, nodes, stats, ("load", "aggregate"))
    assert wide.where("licence_no = 'ED-A'").first().mean_premium == 5.0
    changed = signal.changes(spark.createDataFrame(list(got.values()), wide.schema), wide)
    assert rows(changed.select("licence_no"), "licence_no") == [("ED-A",), ("ED-B",)]
    told = spark.createDataFrame([("ED-A", True, 10.0), ("ED-B", True, 30.0), ("ED-D", False, 20.0)], "licence_no string, reported boolean, customers double")
    over = spark.createDataFrame([("ED-D", "approved", "known")], "licence_no string, owner_override string, reason string")
    out = {r.licence_no: r for r in signal.approve(spark.createDataFrame(list(got.values()), wide.schema), told, signal.check_overrides(over)).collect()}
    assert (out["ED-A"].owner_status, out["ED-A"].status_reason) == ("approved", signal.RULE)
    assert out["ED-B"].status_reason == "method=nearest_within_30km"
    assert out["ED-C"].status_reason == "no load node within 30 km; method=none; no adoption data"
    assert (out["ED-D"].owner_status, out["ED-D"].status_reason) == ("approved", "owner_override=approved: known (rule would be rejected)")
    assert rows(signal.review(wide, told, 2).select("licence_no")) == [("ED-B",), ("ED-D",)]
    with pytest.raises(ValueError, match="malformed"):
        signal.check_overrides(over.withColumn("owner_override", F.lit("maybe")))


def test_shared_edges_count_twice(spark):
    layer = spark.createDataFrame([("A", square(0, 0)), ("B", square(10_000, 0))], f"z string, geometry {POLYGONS}")
    points = spark.createDataFrame([("p", 10_000.0, 5_000.0), ("q", None, 1.0)], "k string, x double, y double")
    assert rows(spatial.inside(points, layer, 7_000.0).select("k", "z"), "z") == [("p", "A"), ("p", "B")]


def test_quarantine(spark):
    nodes = spark.createDataFrame([("NORTHBAY-LT.T", -79.4, 46.3), ("NORTHBAYGS-LT.G", -82.0, 46.3), ("TORONTO-LT.A", -79.4, 43.6), ("TORONTO-LT.B", -79.41, 43.6), ("ALONE-LT.T", -80.0, 44.0)], "Location string, Longitude double, Latitude double")
    assert rows(spatial.quarantine(nodes).select("Location"), "Location") == [("NORTHBAY-LT.T",), ("NORTHBAYGS-LT.G",)]
    assert ("ALONE-LT.T",) in rows(spatial.quarantine(nodes, ("ALONE-LT.T",)).select("Location"))


def test_nearest_point_over_the_date_line(spark):
    a = spark.createDataFrame([("a", 179.95, 10.0), ("b", 0.0, 89.9)], "l string, lon double, lat double")
    b = spark.createDataFrame([("x", -179.95, 10.0), ("y", 178.0, 10.0), ("z", 170.0, 89.9)], "r string, lon double, lat double")
    assert [r[:2] for r in rows(spatial.nearest_point(a, b, "l", "r", 50.0), "l")] == [("a", "x"), ("b", "z")]


def test_adoption(spark):
    raw = spark.createDataFrame([("A", "2024", "10", "100.5"), ("A", "2024", "5", None), ("A", "2023", "99", "9"), ("B", "2024", "1,000", "1"), ("B", "n/a", "7", "7")], "Current_Company_Name string, Year string, n string, kw string")
    t1 = adoption.sums(raw, {"customers": "n", "capacity_kw": "kw"})
    assert rows(t1, "company") == [("A", 15.0, 100.5), ("B", 1000.0, 1.0)]
    t3 = spark.createDataFrame([("A", 2.0, 900.0)], "company string, facilities double, capacity_kw double")
    t4 = spark.createDataFrame([("A", "Solar", 3.0, 50.0), ("A", "Fusion", 1.0, 1.0)], "company string, fuel string, facilities double, capacity_kw double")
    customers = spark.createDataFrame([("A", 2000.0), ("C", 0.0), ("S", 500.0)], "company string, customers double")
    features = spark.createDataFrame([("L1", "a", False, None, []), ("L2", "b", True, None, []), ("L3", "c", False, None, []), ("L4", "d", False, None, ["L9"]), ("L5", "e", False, None, ["L8"])], "licence_no string, utility_name string, excluded boolean, legacy_licence_no string, merged_licences array<string>")
    recon = spark.createDataFrame([("L1", ["A"]), ("L2", ["A"]), ("L3", ["C"]), ("L4", ["A"]), ("L9", ["A"]), ("L5", ["A"]), ("L8", ["S"])], "licence_no string, rrr_names array<string>")
    got = {r.licence_no: r for r in adoption.adoption(features, recon, t1, t3, t4, customers).collect()}
    assert (got["L1"].reported, got["L1"].customers, got["L1"].solar_capacity_mw, got["L1"].wind_facilities) == (True, 2000.0, 0.05, 0.0)
    assert got["L1"].total_der_capacity_mw == pytest.approx(1.0005, abs=0.001) and got["L1"].capacity_per_1000_customers_mw == pytest.approx(0.50025, abs=1e-4)
    assert not got["L2"].reported and got["L2"].customers is None and not got["L3"].reported
    assert got["L4"].customers == 2000.0 and got["L5"].customers == 2500.0
    assert rows(adoption.unexpected(t4, "fuel", adoption.FUELS)) == [("Fusion", 1)]
    low, high = adoption.extremes(spark.createDataFrame(list(got.values()), adoption.adoption(features, recon, t1, t3, t4, customers).schema), "customers", 1)
    assert (low.first().licence_no, high.first().licence_no) == ("L1", "L5")


def test_crosscheck(spark):
    kinds = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "kind string")
    told = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", 100.0), ("d", 0.0)], "kind string, mw double")
    got = spark.createDataFrame([("a", 125.0), ("b", 70.0), ("c", 110.0), ("d", 50.0)], "kind string, mw double")
    assert [r.flag for r in adoption.crosscheck(told, got, kinds).orderBy("kind").collect()] == [True, True, False, False]


GOOD = [("ED-2001-0001", "merge_into", "ED-2001-0002", "o", "final"), ("ED-2001-0003", "relicensed_as", "ED-2020-0001", "o", "provisional"), ("ED-2001-0004", "exclude_no_rrr", "", "o", "final"), ("ED-2001-0005", "unresolved_lookup", None, "o", "final")]
COLUMNS = "licence_no string, decision string, target_licence_no string, decided_by string, status string"


def layer(spark):
    return spark.createDataFrame([(f"ED-2001-000{i}", f"u{i}", square(i * 20_000, 0, 5_000)) for i in range(1, 7)], f"licence_no string, utility_name string, geometry {POLYGONS}")


def test_decisions(spark):
    from voltaic.functions import geo

    d = decisions.validate(spark.createDataFrame(GOOD, COLUMNS), layer(spark))
    got = {r.utility_name: r for r in decisions.apply(layer(spark), d).withColumn("area", geo.area(F.col("geometry"))).collect()}
    assert len(got) == 5 and got["u2"].merged_licences == ["ED-2001-0001"] and got["u2"].area == 5e7 and got["u2"].decision == "merge_target"
    assert (got["u3"].licence_no, got["u3"].legacy_licence_no) == ("ED-2020-0001", "ED-2001-0003")
    assert got["u4"].excluded and got["u5"].licence_not_current and got["u6"].decision == "none"


@pytest.mark.parametrize(
    "row,problem",
    [(("X", "exclude_no_rrr", "", "o", "final"), "bad licence_no"), (("ED-2001-0001", "drop", "", "o", "final"), "bad decision"), (("ED-2001-0001", "exclude_no_rrr", "", "o", "maybe"), "bad status"), (("ED-2001-0001", "exclude_no_rrr", "", "", "final"), "decided_by"), (("ED-2001-0001", "merge_into", "", "o", "final"), "target missing"), (("ED-2001-0001", "merge_into", "ED-2001-0001", "o", "final"), "itself"), (("ED-2001-0001", "merge_into", "ED-1999-0001", "o", "final"), "not in layer"), (("ED-2001-0001", "relicensed_as", "ED-2001-0002", "o", "final"), "already in layer"), (("ED-2001-0001", "exclude_no_rrr", "ED-2001-0002", "o", "final"), "takes no target"), (("ED-1999-0001", "exclude_no_rrr", "", "o", "final"), "not in layer")],
)
def test_malformed_decisions(spark, row, problem):
    with pytest.raises(ValueError, match=problem):
        decisions.validate(spark.createDataFrame([row], COLUMNS), layer(spark))


def test_twice_and_chained_decisions(spark):
    with pytest.raises(ValueError, match="twice"):
        decisions.validate(spark.createDataFrame([GOOD[2], GOOD[2]], COLUMNS))
    circle = [("ED-2001-0001", "merge_into", "ED-2001-0002", "o", "final"), ("ED-2001-0002", "merge_into", "ED-2001-0003", "o", "final"), ("ED-2001-0003", "merge_into", "ED-2001-0001", "o", "final")]
    with pytest.raises(ValueError, match="circle"):
        decisions.validate(spark.createDataFrame(circle, COLUMNS))
    assert decisions.validate(spark.createDataFrame(circle[:2], COLUMNS)).count() == 2


def test_year_ranges_and_kinds(spark):
    a = spark.createDataFrame([("2019",), (" 2021 ",), ("n/a",), (None,)], "Year string")
    out = adoption.year_ranges({"a": a, "none": a.limit(0)})
    assert sorted(map(tuple, out.collect())) == [("a", 2019, 2021), ("none", None, None)]
    rows = spark.createDataFrame([("S", 1.5), ("S", None), ("X", 2.0), (None, 4.0)], "fuel string, mw_ double")
    kinds = spark.createDataFrame([("S", "Solar")], "fuel string, kind string")
    assert {tuple(r) for r in adoption.by_kind(rows, kinds, "mw_").collect()} == {("Solar", 2, 1.5), (None, 2, 6.0)}
