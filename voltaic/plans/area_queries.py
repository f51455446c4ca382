"""Queries over areas, companies, decisions, files and hourly values, each with the same rows as SQL.

The driver's tables have no areas, so nations stand for service areas, suppliers for companies, customers for nodes and
orders for published files; coordinates are made from keys. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, overlay, stats, text, time
from ..operators import adoption, decisions, inputs, merge, names, nodal, signal, spatial, value, zones
from . import queries as base
from .queries import customer, events, lineitem, nation, orders, part, supplier

SHAPE = "array<array<array<struct<x:double,y:double>>>>"
#: The owner's decisions on nations: key, kind, key of the target, status.
DECISIONS = (
    (1, "merge_into", 0, "final"), (6, "merge_into", 0, "provisional"), (8, "merge_into", 7, "final"), (2, "exclude_no_rrr", None, "final"),
    (9, "exclude_no_rrr", None, "provisional"), (3, "relicensed_as", 103, "final"), (4, "unresolved_lookup", None, "provisional"),
)
WEIGHTS = (("A", 3, 0.25), ("A", 4, 0.75), ("R", 1, 1.0))
EXPECTED = ("BUILDING", "HOUSEHOLD", "MACHINERY")
#: Kinds of parts, by type and size class; the other combinations have no mapping.
KINDS = (("ECONOMY", "small", "Solar"), ("ECONOMY", "large", "Wind"), ("PROMO", "small", "Water"), ("STANDARD", "small", "Solar"), ("STANDARD", "large", "Other"))


def _licence(key: Column) -> Column:
    return F.concat(F.lit("ED-2000-"), F.lpad(key.cast("string"), 4, "0"))


def _box(x: Column, y: Column, wide: Column, high: Column) -> Column:
    """One rectangle as a geometry."""
    corners = ((x, y), (x + wide, y), (x + wide, y + high), (x, y + high), (x, y))
    return F.array(F.array(F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in corners])))


def _features(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    merged = F.when(k % 5 == 0, F.array(F.concat(F.lit("M-"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    return nation(spark, d).select(k.cast("string").alias("licence_no"), F.col("n_name").alias("utility_name"), (k % 9 == 4).alias("excluded"), F.when(k % 8 == 6, F.concat(F.lit("OLD-"), k.cast("string"))).alias("legacy_licence_no"), merged.alias("merged_licences"))


def _recon(spark, d) -> DataFrame:
    """Names by licence: a nation's suppliers, some under an old licence; a merged licence has the next nation's, or the very same."""
    n, s = nation(spark, d), supplier(spark, d)
    k = F.col("n_nationkey")
    own = n.join(s, k == F.col("s_nationkey")).select(F.concat(F.when(k % 8 == 6, "OLD-").otherwise(""), k.cast("string")).alias("licence_no"), "s_name")
    of = F.when(k % 10 == 5, k).otherwise((k + 1) % 25)
    merged = n.where(k % 5 == 0).join(s, of == F.col("s_nationkey")).select(F.concat(F.lit("M-"), k.cast("string")).alias("licence_no"), "s_name")
    return own.unionByName(merged).groupBy("licence_no").agg(F.collect_list("s_name").alias("rrr_names"))


def _filings(spark, d) -> DataFrame:
    """Order lines as rows of a regulator's table: company, year, and values as text."""
    fuel = F.element_at(F.array(*[F.lit(f) for f in adoption.FUELS]), (F.col("l_linenumber") % len(adoption.FUELS) + 1).cast("int"))
    lines = lineitem(spark, d).join(supplier(spark, d), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.select(
        F.concat(F.lit(" "), F.col("s_name")).alias(adoption.COMPANY), F.date_format("l_shipdate", "yyyy").alias("Year"), fuel.alias("fuel"), "l_returnflag", "l_linestatus",
        F.col("l_quantity").cast("string").alias("Capacity"), F.col("l_linenumber").cast("string").alias("Count"),
    )


def merged_licence_names(spark, d):
    filed = adoption.latest_year(_filings(spark, d)).select(F.trim(adoption.COMPANY).alias("company"))
    return adoption.names_of(_features(spark, d), _recon(spark, d), filed)


def adoption_by_area(spark, d):
    filings = _filings(spark, d)
    t1 = adoption.sums(filings, {"customers": "Count", "capacity_kw": "Capacity"}, where="l_returnflag = 'A'")
    t3 = adoption.sums(filings, {"facilities": "Count", "capacity_kw": "Capacity"}, where="l_returnflag = 'R'")
    t4 = adoption.sums(filings, {"facilities": "Count", "capacity_kw": "Capacity"}, "fuel")
    served = adoption.sums(filings, {"customers": "Capacity"}, where="l_linestatus = 'O'")
    return adoption.adoption(_features(spark, d), _recon(spark, d), t1, t3, t4, served)


def unexpected_values(spark, d):
    return adoption.unexpected(customer(spark, d), "c_mktsegment", EXPECTED)


def extremes_by_metric(spark, d):
    per = orders(spark, d).groupBy(F.col("o_custkey").alias("licence_no")).agg(stats.exact_sum(F.col("o_totalprice")).alias("total"))
    least, most = adoption.extremes(per, "total")
    return least.withColumn("side", F.lit("least")).unionByName(most.withColumn("side", F.lit("most")))


def year_range_per_table(spark, d):
    dated = {"orders": orders(spark, d).select(F.date_format("o_orderdate", "yyyy").alias("Year")), "lineitem": lineitem(spark, d).select(F.date_format("l_shipdate", "yyyy").alias("Year"))}
    return adoption.year_ranges(dated)


def contract_kind_map(spark, d):
    rows = part(spark, d).select("p_type", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("size_class"), "p_retailprice")
    mapping = spark.createDataFrame(list(KINDS), "p_type string, size_class string, kind string")
    return adoption.by_kind(rows, mapping, "p_retailprice")


def _layer(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    return nation(spark, d).select(_licence(k).alias("licence_no"), F.col("n_name").alias("utility_name"), _box(k * 100_000, F.lit(0), (k + 1) * 1000, F.lit(500)).alias("geometry"))


def _decisions(spark) -> DataFrame:
    rows = [(f"ED-2000-{a:04d}", kind, None if b is None else f"ED-{2001 if b > 100 else 2000}-{b:04d}", "owner", status) for a, kind, b, status in DECISIONS]
    return spark.createDataFrame(rows, "licence_no string, decision string, target_licence_no string, decided_by string, status string")


def decisions_applied(spark, d):
    layer = _layer(spark, d)
    out = decisions.apply(layer, decisions.validate(_decisions(spark), layer))
    return out.withColumn("n_polygons", F.size("geometry")).withColumn("area", geo.area(F.col("geometry"))).withColumn("merged_licences", F.array_join("merged_licences", ";")).drop("geometry")


def decision_chains(spark, d):
    """Customers as areas, each merged into, or renamed to, what another decision concerns: chains of up to eight."""
    k = F.col("c_custkey")
    place = k % 9
    number = lambda at: F.format_string("ED-2000-%04d", at)
    layer = customer(spark, d).select(k.cast("string").alias("licence_no"), F.col("c_name").alias("utility_name"), _box(k * 10, F.lit(0), F.lit(12), F.lit(10)).alias("geometry"))
    # Of nine areas in a row: 1 to 4 merge into the next one, 5 is renamed, 6 and 7 merge into 8; 8 is excluded.
    kind = F.when(place.between(1, 4) | place.between(6, 7), "merge_into").when(place == 5, "relicensed_as").when(place == 8, "exclude_no_rrr")
    target = F.when(kind == "relicensed_as", F.concat(F.lit("N"), k.cast("string"))).when(kind == "merge_into", F.when(place == 6, k + 2).otherwise(k + 1).cast("string"))
    last = customer(spark, d).agg(F.max("c_custkey").alias("last_"))
    whole = customer(spark, d).crossJoin(F.broadcast(last)).where(F.floor(k / 9) < F.floor((F.col("last_") + 1) / 9))  # one row
    rows = whole.select(k.cast("string").alias("licence_no"), kind.alias("decision"), target.alias("target_licence_no"), F.lit("final").alias("status"), k.alias("at")).where("decision is not null")
    out = decisions.apply(layer, rows, "at")
    return out.select("licence_no", "decision", "excluded", "legacy_licence_no", F.array_join("merged_licences", ";").alias("merged_licences"), geo.area(F.col("geometry")).alias("area"), F.size("geometry").alias("n_polygons"))


def decision_rules(spark, d):
    """Customers as rows of a decisions file in which much is wrong."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    lic = F.when(k % 11 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise(_licence(k % 1000))
    kind = F.element_at(F.array(*[F.lit(x) for x in (*decisions.KINDS, "drop", "")]), (n % 6 + 1).cast("int"))
    target = F.when(n % 5 == 0, "").when(n % 5 == 1, "ED-2000-0001").when(n % 5 == 2, "ED-1").when(n % 5 == 3, lic).otherwise("ED-2099-0001")
    status = F.when(F.col("c_mktsegment") == "BUILDING", "open").when(F.col("c_mktsegment") == "HOUSEHOLD", "provisional").otherwise("final")
    rows = customer(spark, d).select(lic.alias("licence_no"), kind.alias("decision"), target.alias("target_licence_no"), F.when(F.col("c_acctbal") > 0, "owner").alias("decided_by"), status.alias("status"))
    layer = supplier(spark, d).select(_licence(F.col("s_suppkey") % 10_000).alias("licence_no"))
    return decisions.violations(rows, layer).select("licence_no", F.array_join("problems", "; ").alias("problems"))


def _hourly(spark, d) -> DataFrame:
    """Purchases as prices, errors as the adjustment, clicks and views as solar and gas."""
    e = base._instants(spark, d).withColumnRenamed("instant", value.KEY)

    def only(kind: str) -> Column:
        return F.when(F.col("event_type") == kind, F.col("value"))

    price = e.where("event_type = 'purchase'").groupBy(value.KEY).agg(stats.exact_sum(F.col("value")).alias("price"))
    rate = e.where("event_type = 'error'").groupBy(value.KEY).agg(stats.exact_sum(F.col("value")).alias("rate"))
    fuel = e.groupBy(value.KEY).agg(stats.exact_sum(only("click")).alias("solar"), stats.exact_sum(only("view")).alias("gas"))
    return value.hourly(price, rate, fuel, base.tariffs(spark), base.holidays(spark), plans=["TOU", "ULO"])


def value_hourly(spark, d):
    plans = [f"{p}_{c}" for p in ("tou", "ulo") for c in ("period", "offset", "wedge")]
    return _hourly(spark, d).select(F.date_format(value.KEY, "yyyy-MM-dd HH:mm:ss").alias("utc"), "price", "rate", "energy_price", "solar_mw", "solar_share", *plans)


def value_summary(spark, d):
    out = value.summary(_hourly(spark, d))
    when = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("window_start", "window_end")]
    return out.select(*when, "hours", *[F.round(c, 6).alias(c) for c in ("coverage_pct", "mean_energy_price", "mean_wedge")])


def value_by_period(spark, d):
    return value.period_table(_hourly(spark, d), "ulo").select("period", F.round("mean_wedge", 6).alias("mean_wedge"), "hours")


def _nodes(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.element_at(F.array(F.lit("load"), F.lit("bus"), F.lit("generator")), (k % 3 + 1).cast("int"))
    return customer(spark, d).select(F.col("c_name").alias("Location"), kind.alias("node_type"), (k * 37 % 1009 * 297.0).alias("x"), (k * 91 % 1013 * 293.0).alias("y"))


def _service_areas(spark, d) -> DataFrame:
    """Nations on a grid: wide ones, tiny ones that hold no node, and some far from all nodes."""
    k = F.col("n_nationkey")
    side = F.when(k % 4 == 3, 1.0).otherwise(45_000.0)
    x = (k % 5) * 60_000.0 + F.when(k % 6 == 5, 10_000_000.0).otherwise(0.0)
    return nation(spark, d).select(k.cast("string").alias("licence_no"), F.col("n_name").alias("utility_name"), _box(x, F.floor(k / 5) * 60_000.0, side, side).alias("geometry"))


def polygon_to_nearest_point(spark, d):
    out = spatial.nearest(_service_areas(spark, d), _nodes(spark, d), "licence_no", "Location", 30_000.0)
    return out.select("licence_no", "Location", F.round("distance", 6).alias("distance"))


def _node_stats(spark, d) -> DataFrame:
    """Nodes with orders have prices."""
    o = orders(spark, d).join(customer(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    mean = stats.exact_sum(F.col("o_totalprice")) / F.count("*")
    return o.groupBy(F.col("c_name").alias("node")).agg((mean / 20_000).alias("mean_premium"), (mean / 50_000).alias("mean_congestion"), (F.count("*") / 10).alias("mean_loss"))


def locational_signal(spark, d):
    out = signal.build(_service_areas(spark, d), _nodes(spark, d), _node_stats(spark, d), ("load", "bus"))
    rounded = [F.round(c, 6).alias(c) for c in ("mean_premium", "std_premium", "mean_congestion", "mean_loss", "span_km")]
    return out.select("licence_no", "utility_name", "n_nodes", "node_names", "node_types", "method", "distance_km", "heterogeneous", *rounded)


def signal_changes(spark, d):
    def means(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("s_nationkey").alias("licence_no")).agg((stats.exact_sum(F.col("s_acctbal")) / F.count("*")).alias("mean_premium"))

    s = supplier(spark, d)
    return signal.changes(means(s), means(s.where("s_acctbal > 0")), 500.0)


def weight_overrides(spark, d):
    lines = lineitem(spark, d).join(supplier(spark, d), F.col("l_suppkey") == F.col("s_suppkey"))
    own = spark.createDataFrame(list(WEIGHTS), "l_returnflag string, s_nationkey int, weight double")
    out = zones.with_overrides(zones.votes(lines, "l_returnflag", "s_nationkey"), own, "l_returnflag", "s_nationkey")
    return zones.check_weights(out, "l_returnflag")


def primary_zone(spark, d):
    lines = lineitem(spark, d).join(supplier(spark, d), F.col("l_suppkey") == F.col("s_suppkey"))
    return zones.primary(zones.votes(lines, "l_partkey", "s_nationkey"), "l_partkey", "s_nationkey")


def merge_old_and_new(spark, d):
    """The log's earlier half, merged with a newer one that lacks a column and has keys twice."""
    e = events(spark, d)
    keys = ["user_id", "event_type"]
    old = merge.keep_last(e.where("ts < timestamp '2024-01-15'").select(*keys, "event_id", "ts", "value", "props"), keys, "event_id")
    new = e.where("ts >= timestamp '2024-01-15'").select(*keys, "event_id", "ts", "value")
    return merge.merge(old, new, keys, "event_id", since=F.col("ts") >= F.lit("2024-01-05").cast("timestamp")).drop("ts")


def _files(spark, d) -> DataFrame:
    """An order is a file of its date, final or a version."""
    v = F.col("o_orderkey") % 12
    return orders(spark, d).select(F.concat(F.lit("PUB_Price_"), F.date_format("o_orderdate", "yyyyMMdd"), F.when(v > 0, F.concat(F.lit("_v"), v.cast("string"))).otherwise(""), F.lit(".csv")).alias("name"))


def file_per_date(spark, d):
    return merge.winner_per_date(_files(spark, d))


def newest_file(spark, d):
    return merge.latest_file(_files(spark, d))


def changed_files(spark, d):
    rows = orders(spark, d).select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderdate").alias("mtime"), F.floor("o_totalprice").alias("size"), "o_orderstatus")
    known = rows.where("o_orderstatus <> 'P'").withColumn("size", F.col("size") + (F.col("o_orderstatus") == "F").cast("int"))
    return merge.changed_files(rows.drop("o_orderstatus"), known).select("name", "size")


def duplicate_keys(spark, d):
    return inputs.duplicates(orders(spark, d), "o_custkey", "o_orderpriority")


def parsed_numbers(spark, d):
    shown = F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.concat(F.lit(" "), F.format_number("o_totalprice", 2)))
    return orders(spark, d).select("o_orderkey", text.number(shown).alias("total"))


def station_zone_match(spark, d):
    s, k = supplier(spark, d), F.col("s_suppkey")
    own = F.concat(F.lit("Z"), (F.col("s_nationkey") % 5).cast("string"))
    other = F.when(k % 4 == 0, "ZX").otherwise(own)
    stations = s.select(F.concat("s_name", F.lit(" TS")).alias("station_name"), own.alias("electrical_zone")).unionByName(s.select(F.concat("s_name", F.lit(" DS")).alias("station_name"), other.alias("electrical_zone")))
    nodes = customer(spark, d).select("c_custkey", F.concat(F.lit("SUPPLIER"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("A-LT.G1")).alias("node_id"))
    return names.match_zones(nodes, stations).select("c_custkey", "zone", "matched_station", "zone_method")


def _rebuilt(spark, d) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    side = (k % 10 + 1) * 100
    parts = supplier(spark, d).select(F.col("s_nationkey").alias("licence_no"), _box(k * 10_000, F.lit(0), side, side).alias("geometry"))
    supplied = supplier(spark, d).groupBy(F.col("s_nationkey").alias("licence_no")).agg(F.count("*").alias("n_")).select("licence_no", _box(F.lit(0), F.lit(0), F.col("n_") * 50, F.lit(1000)).alias("geometry"))
    return inputs.dissolve_disjoint(parts, "licence_no"), supplied


def rebuilt_areas(spark, d):
    rebuilt, supplied = _rebuilt(spark, d)
    return inputs.compare_areas(rebuilt, supplied).join(rebuilt.select("licence_no", "n_source_features"), "licence_no")


def worst_area(spark, d):
    return inputs.worst(inputs.compare_areas(*_rebuilt(spark, d)))


def geometry_problems(spark, d):
    k = F.col("p_partkey")
    x = k.cast("double")

    def ring(*corners: tuple[float, float]) -> Column:
        return F.array(F.array(F.array(*[F.struct((x + a).alias("x"), F.lit(b).alias("y")) for a, b in corners])))

    shape = (
        F.when(k % 5 == 0, ring((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0))).when(k % 5 == 1, ring((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)))
        .when(k % 5 == 2, ring((0.0, 0.0), (1.0, 0.0), (0.0, 0.0))).when(k % 5 == 3, ring((0.0, 0.0), (1.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)))
    )
    return part(spark, d).select("p_partkey", F.array_join(geo.problems(shape.cast(SHAPE)), "; ").alias("problems"))


def _broken(k: Column) -> Column:
    """A shape for each key, moved by it: sound, a bow-tie, a spike, nested, overlapping and equal shells, a hole across its shell."""
    x = k.cast("double")

    def ring(*corners: tuple[float, float]) -> Column:
        return F.array(*[F.struct((x + a).alias("x"), F.lit(float(b)).alias("y")) for a, b in (*corners, corners[0])])

    def square(at: float, side: float) -> Column:
        return ring((at, at), (at + side, at), (at + side, at + side), (at, at + side))

    shapes = (
        F.array(F.array(square(0, 4), square(1, 2))), F.array(F.array(ring((0, 0), (4, 4), (4, 0), (0, 4)))), F.array(F.array(ring((0, 0), (4, 0), (9, 0), (4, 0), (4, 4), (0, 4)))), F.array(F.array(square(0, 10)), F.array(square(2, 5))),
        F.array(F.array(square(0, 4)), F.array(square(2, 4))), F.array(F.array(square(0, 4)), F.array(square(0, 4))), F.array(F.array(square(0, 4), ring((2, 1), (6, 1), (6, 3), (2, 3)))),
    )
    out = F.lit(None).cast(SHAPE)
    for i, shape in enumerate(shapes):
        out = F.when(k % 8 == i, shape.cast(SHAPE)).otherwise(out)
    return out


def repaired_polygons(spark, d):
    # Keys are few bytes and repairs much work: a small file's one or two tasks are dealt to all cores.
    keys = part(spark, d).select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism)
    rows = keys.select("p_partkey", overlay.repaired(_broken(F.col("p_partkey"))).alias("s"))
    return rows.select("p_partkey", "s.repaired", geo.area(F.col("s.geometry")).alias("area"), F.size("s.geometry").alias("n_polygons"), F.size(F.flatten("s.geometry")).alias("n_rings"))


def dissolved_overlaps(spark, d):
    """Customers of a nation as steps that overlap the next one each, and of each segment as boxes side by side."""
    k = F.col("c_custkey")
    nth = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    steps = customer(spark, d).withColumn("nth", nth).select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("area_of"), _box(F.col("nth") * 60, F.col("nth") * 10, F.lit(100), F.lit(100)).alias("geometry"))
    row = customer(spark, d).select(F.col("c_mktsegment").alias("area_of"), _box(k * 10, F.lit(0), F.lit(10), F.lit(5)).alias("geometry"))
    out = inputs.dissolve(steps.unionByName(row), "area_of")
    return out.select("area_of", "n_source_features", geo.area(F.col("geometry")).alias("area"))


def points_in_areas(spark, d):
    """Orders as points in areas from a street's width to a country's: nested squares with holes around the middle of the field."""
    k = F.col("n_nationkey")
    half = F.pow(F.lit(2.0), (k % 15).cast("double"))

    def square(x: float, side: Column) -> Column:
        corners = ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))
        return F.array(*[F.struct((F.lit(x) + a * side).alias("x"), (b * side).alias("y")) for a, b in corners])

    middle = 3000.0
    areas = nation(spark, d).select("n_nationkey", F.array(F.array(square(middle, half), square(middle, half / 4))).cast(SHAPE).alias("geometry"))
    points = orders(spark, d).select("o_orderkey", (F.col("o_orderkey") * 37 % 6007).cast("double").alias("x"), (F.col("o_orderkey") * 91 % 4001 - 2000).cast("double").alias("y"))
    return spatial.inside(points, areas, 1.0).groupBy("n_nationkey").agg(F.count("*").alias("n"), F.sum("o_orderkey").cast("long").alias("keys"))


def projection_round_trip(spark, d):
    places = base._places(customer(spark, d), "c_custkey", "c", 1.0).withColumn("at", geo.project(F.col("lon"), F.col("lat")))
    back = places.withColumn("back", geo.unproject(F.col("at.x"), F.col("at.y")))
    return back.select("c", F.round("at.x", 3).alias("x"), F.round("at.y", 3).alias("y"), F.round("back.lon", 7).alias("lon"), F.round("back.lat", 7).alias("lat"))


def zonal_window_mean(spark, d):
    zonal = orders(spark, d).groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("date")).agg(F.floor(stats.exact_sum(F.col("o_totalprice")) / F.count("*")).cast("double").alias("price"))
    out = nodal.window_means(base._daily(spark, d), zonal, days=400, least_days=12)
    return out.select("node_id", "hours", "known_hours", F.round("mean_lmp", 6).alias("mean_lmp"))


def holiday_orders(spark, d):
    o = orders(spark, d).select(F.to_date("o_orderdate").alias("date"))
    return o.join(time.holiday_table(spark, range(1995, 2002), civic=True), "date").groupBy("name").agg(F.count("*").alias("n"))


_NAMES = """n AS (SELECT *, CAST(n_nationkey AS VARCHAR) AS lic FROM nation),
own AS (SELECT lic AS licence_no, s_name AS company FROM n JOIN supplier ON s_nationkey = n_nationkey),
merged AS (SELECT lic AS licence_no, s_name AS company FROM n JOIN supplier ON s_nationkey = CASE WHEN n_nationkey % 10 = 5 THEN n_nationkey ELSE (n_nationkey + 1) % 25 END WHERE n_nationkey % 5 = 0),
filed AS (SELECT s_name AS company, l_returnflag, l_linestatus, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE year(l_shipdate) = (SELECT max(year(l_shipdate)) FROM lineitem)),
news AS (SELECT DISTINCT licence_no FROM merged m WHERE company IN (SELECT company FROM filed) AND NOT EXISTS (SELECT 1 FROM own o WHERE o.licence_no = m.licence_no AND o.company = m.company)),
names AS (SELECT * FROM own UNION SELECT * FROM merged WHERE licence_no IN (SELECT licence_no FROM news))"""
_FUEL_SUMS = ", ".join(f"sum({v}) FILTER (l_linenumber % {len(adoption.FUELS)} = {i}) AS f{i}_{m}" for i in range(len(adoption.FUELS)) for m, v in (("n", "l_linenumber"), ("kw", "q")))
_FUEL_METRICS = ", ".join(f"CASE WHEN told THEN CAST(coalesce(f{i}_n, 0) AS DOUBLE) END AS {text.column_name(f)}_facilities, CASE WHEN told THEN round(coalesce(f{i}_kw, 0) / 1000, 3) END AS {text.column_name(f)}_capacity_mw" for i, f in enumerate(adoption.FUELS))
_DECIDED = "(VALUES " + ", ".join(f"({a}, '{kind}', {'NULL' if b is None else b}, '{s}')" for a, kind, b, s in DECISIONS) + ") AS t(a, kind, b, status)"
_HOURS = f"""hours AS (SELECT DISTINCT {base._UTC} AS utc, local_date, local_hour, season, day_type FROM ({base._TYPED})),
sums AS (SELECT {base._UTC} AS utc, {', '.join(f"CAST(sum(CAST(value AS DECIMAL(28,4))) FILTER (event_type = '{t}') AS DOUBLE) AS {n}" for t, n in (('purchase', 'price'), ('error', 'rate'), ('click', 'solar'), ('view', 'gas')))} FROM events GROUP BY 1),
v AS (SELECT s.utc, s.price, rate, s.price + rate AS energy_price, coalesce(solar, 0.0::DOUBLE) AS solar_mw, CASE WHEN coalesce(solar, 0) + coalesce(gas, 0) > 0 THEN coalesce(solar, 0) / (coalesce(solar, 0) + coalesce(gas, 0)) END AS solar_share,
  {', '.join(f"{p}.period AS {p}_period, {p}.price * 10 AS {p}_offset, {p}.price * 10 - (s.price + s.rate) AS {p}_wedge" for p in ('tou', 'ulo'))}
  FROM sums s JOIN hours h ON s.utc = h.utc {' '.join(f"LEFT JOIN (SELECT * FROM {base._TARIFF} WHERE plan = '{p.upper()}') {p} ON h.season = {p}.t_season AND h.day_type = {p}.t_day AND local_hour >= {p}.h0 AND local_hour < {p}.h1 AND local_date BETWEEN {p}.ef AND {p}.et" for p in ('tou', 'ulo'))}
  WHERE s.price IS NOT NULL AND rate IS NOT NULL)"""
_PLACED = """box AS (SELECT CAST(n_nationkey AS VARCHAR) AS licence_no, n_name, (n_nationkey % 5) * 60000.0::DOUBLE + CASE WHEN n_nationkey % 6 = 5 THEN 10000000.0 ELSE 0.0 END AS x0, (n_nationkey // 5) * 60000.0::DOUBLE AS y0, CASE WHEN n_nationkey % 4 = 3 THEN 1.0::DOUBLE ELSE 45000.0::DOUBLE END AS side FROM nation),
node AS (SELECT c_custkey, c_name AS "Location", (['load', 'bus', 'generator'])[c_custkey % 3 + 1] AS kind, c_custkey * 37 % 1009 * 297.0::DOUBLE AS x, c_custkey * 91 % 1013 * 293.0::DOUBLE AS y FROM customer),
far AS (SELECT *, sqrt(pow(greatest(x0 - x, 0, x - x0 - side), 2) + pow(greatest(y0 - y, 0, y - y0 - side), 2)) AS distance FROM box, node)"""
_FILE = "SELECT 'PUB_Price_' || strftime(o_orderdate, '%Y%m%d') || CASE WHEN o_orderkey % 12 > 0 THEN '_v' || (o_orderkey % 12) ELSE '' END || '.csv' AS name, strftime(o_orderdate, '%Y%m%d') AS date, o_orderkey % 12 AS v FROM orders"
_SPARED = "WITH a AS (SELECT s_nationkey AS licence_no, count(*) AS n, CAST(sum(pow((s_suppkey % 10 + 1) * 100, 2)) AS DOUBLE) AS a FROM supplier GROUP BY 1), x AS (SELECT licence_no, abs(a - n * 50000.0::DOUBLE) / (n * 50000.0::DOUBLE) AS difference, n FROM a)"


def _conic_sql() -> str:
    e, n, f, r0 = geo._conic()
    s = "sin(radians(lat))"
    return f"""r AS (SELECT c, lon, lat, {geo.AXIS * f!r}::DOUBLE * pow(tan(pi() / 4 - radians(lat) / 2) / pow((1 - {e!r}::DOUBLE * {s}) / (1 + {e!r}::DOUBLE * {s}), {e / 2!r}::DOUBLE), {n!r}::DOUBLE) AS r, {n!r}::DOUBLE * radians(lon - ({geo.LON0!r})) AS w FROM p)
SELECT c, round({geo.EAST0!r} + r * sin(w), 3) AS x, round({geo.NORTH0!r} + {r0!r}::DOUBLE - r * cos(w), 3) AS y, round(lon, 7) AS lon, round(lat, 7) AS lat FROM r"""


ORACLE = {
    "merged_licence_names": f"WITH {_NAMES} SELECT licence_no, company FROM names",
    "adoption_by_area": f"""WITH {_NAMES},
s AS (SELECT licence_no, sum(l_linenumber) FILTER (l_returnflag = 'A') AS nm, coalesce(sum(q) FILTER (l_returnflag = 'A'), 0) AS nm_kw, sum(l_linenumber) FILTER (l_returnflag = 'R') AS ef, coalesce(sum(q) FILTER (l_returnflag = 'R'), 0) AS emb_kw, CAST(sum(q) FILTER (l_linestatus = 'O') AS DOUBLE) AS c, {_FUEL_SUMS} FROM names JOIN filed USING (company) GROUP BY 1),
t AS (SELECT lic AS licence_no, n_name AS utility_name, n_nationkey % 9 <> 4 AND coalesce(c > 0, false) AS told, s.* EXCLUDE (licence_no) FROM n LEFT JOIN s ON lic = s.licence_no)
SELECT licence_no, utility_name, told AS reported, CASE WHEN told THEN CAST(coalesce(nm, 0) AS DOUBLE) END AS netmetered_customers, CASE WHEN told THEN round(nm_kw / 1000, 3) END AS netmetered_capacity_mw, CASE WHEN told THEN CAST(coalesce(ef, 0) AS DOUBLE) END AS embedded_facilities,
  CASE WHEN told THEN round(emb_kw / 1000, 3) END AS embedded_capacity_mw, CASE WHEN told THEN c END AS customers, CASE WHEN told THEN round((nm_kw + emb_kw) / 1000, 3) END AS total_der_capacity_mw, CASE WHEN told THEN round((nm_kw + emb_kw) / 1000 / c * 1000, 4) END AS capacity_per_1000_customers_mw, {_FUEL_METRICS} FROM t""",
    "unexpected_values": f"SELECT c_mktsegment, count(*) AS count FROM customer WHERE c_mktsegment NOT IN {EXPECTED} GROUP BY 1",
    "extremes_by_metric": """WITH p AS (SELECT o_custkey AS licence_no, CAST(sum(CAST(o_totalprice AS DECIMAL(28,4))) AS DOUBLE) AS total FROM orders GROUP BY 1)
SELECT * FROM (SELECT *, 'least' AS side FROM p ORDER BY total, licence_no LIMIT 5) UNION ALL SELECT * FROM (SELECT *, 'most' AS side FROM p ORDER BY total DESC, licence_no DESC LIMIT 5)""",
    "year_range_per_table": "SELECT 'orders' AS table_name, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year FROM orders UNION ALL SELECT 'lineitem', min(year(l_shipdate)), max(year(l_shipdate)) FROM lineitem",
    "contract_kind_map": f"SELECT kind, count(*) AS n, CAST(sum(CAST(p_retailprice AS DECIMAL(28,4))) AS DOUBLE) AS mw FROM part LEFT JOIN (VALUES {', '.join(map(str, KINDS))}) AS m(t, s, kind) ON p_type = t AND CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END = s GROUP BY 1",
    "decisions_applied": f"""WITH l AS (SELECT n_nationkey AS k, 'ED-2000-' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS lic, n_name, (n_nationkey + 1) * 500000.0::DOUBLE AS area FROM nation), t AS (SELECT * FROM {_DECIDED}),
g AS (SELECT b, count(*) AS n, string_agg(lic, ';' ORDER BY lic) AS merged, max(status) AS status, sum(area) AS area FROM t JOIN l ON a = k WHERE kind = 'merge_into' GROUP BY 1)
SELECT CASE WHEN kind = 'relicensed_as' THEN 'ED-2001-' || lpad(CAST(t.b AS VARCHAR), 4, '0') ELSE lic END AS licence_no, n_name AS utility_name, CASE WHEN g.b IS NOT NULL THEN 'merge_target' ELSE coalesce(kind, 'none') END AS decision, coalesce(g.status, t.status, '') AS decision_status,
  coalesce(kind = 'exclude_no_rrr', false) AS excluded, coalesce(merged, '') AS merged_licences, CASE WHEN kind = 'relicensed_as' THEN lic END AS legacy_licence_no, coalesce(kind = 'unresolved_lookup', false) AS licence_not_current, 1 + coalesce(g.n, 0) AS n_polygons, l.area + coalesce(g.area, 0) AS area
FROM l LEFT JOIN t ON a = k LEFT JOIN g ON g.b = k WHERE coalesce(kind, '') <> 'merge_into'""",
    "decision_chains": """WITH c AS (SELECT c_custkey AS k, c_custkey % 9 AS p, c_custkey // 9 AS g, c_custkey // 9 < ((SELECT max(c_custkey) FROM customer) + 1) // 9 AS whole FROM customer),
e AS (SELECT k, CASE WHEN NOT whole OR p IN (0, 8) THEN k WHEN p <= 5 THEN 9 * g + 5 ELSE 9 * g + 8 END AS last FROM c),
s AS (SELECT last, count(*) AS n, min(k) AS low, bool_or(k = last - 1) AS near FROM e GROUP BY 1)
SELECT CASE WHEN whole AND p = 5 THEN 'N' || k ELSE CAST(k AS VARCHAR) END AS licence_no, CASE WHEN NOT whole OR p = 0 THEN 'none' WHEN p = 5 THEN 'relicensed_as' ELSE 'exclude_no_rrr' END AS decision, whole AND p = 8 AS excluded, CASE WHEN whole AND p = 5 THEN CAST(k AS VARCHAR) END AS legacy_licence_no,
  CASE WHEN whole AND p = 5 AND n > 1 THEN CAST(k - 1 AS VARCHAR) WHEN whole AND p = 8 THEN (k - 2) || ';' || (k - 1) ELSE '' END AS merged_licences, CAST(n * 100 + 20 AS DOUBLE) AS area, 1 AS n_polygons
FROM c JOIN s ON last = k""",
    "decision_rules": rf"""WITH a AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'X' || c_custkey ELSE 'ED-2000-' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 4, '0') END AS lic, ([{', '.join(f"'{k}'" for k in decisions.KINDS)}, 'drop', ''])[c_nationkey % 6 + 1] AS kind, c_nationkey % 5 AS m,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'open' WHEN 'HOUSEHOLD' THEN 'provisional' ELSE 'final' END AS status, c_acctbal > 0 AS signed FROM customer),
b AS (SELECT *, CASE m WHEN 0 THEN '' WHEN 1 THEN 'ED-2000-0001' WHEN 2 THEN 'ED-1' WHEN 3 THEN lic ELSE 'ED-2099-0001' END AS target, count(*) OVER (PARTITION BY lic) > 1 AS twice, kind IN ('merge_into', 'relicensed_as') AS aims FROM a),
ids AS (SELECT DISTINCT 'ED-2000-' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') AS id FROM supplier),
c AS (SELECT b.*, x.id IS NOT NULL AS known, y.id IS NOT NULL AS target_known FROM b LEFT JOIN ids x ON lic = x.id LEFT JOIN ids y ON target = y.id),
f AS (SELECT lic, list_filter([CASE WHEN NOT regexp_matches(lic, '{decisions.LICENCE}') THEN 'bad licence_no' END, CASE WHEN twice THEN 'licence twice' END, CASE WHEN NOT known THEN 'licence not in layer' END, CASE WHEN kind IN ('drop', '') THEN 'bad decision' END, CASE WHEN status = 'open' THEN 'bad status' END,
  CASE WHEN NOT signed THEN 'decided_by is empty' END, CASE WHEN aims AND target = '' THEN 'target missing' END, CASE WHEN aims AND target <> '' AND NOT regexp_matches(target, '{decisions.LICENCE}') THEN 'bad target' END, CASE WHEN aims AND target = lic THEN 'target is the licence itself' END,
  CASE WHEN kind = 'merge_into' AND NOT target_known THEN 'target not in layer' END, CASE WHEN kind = 'relicensed_as' AND target_known THEN 'target already in layer' END, CASE WHEN NOT aims AND target <> '' THEN 'takes no target' END], lambda p: p IS NOT NULL) AS p FROM c)
SELECT lic AS licence_no, array_to_string(p, '; ') AS problems FROM f WHERE len(p) > 0""",
    "value_hourly": f"WITH {_HOURS} SELECT * REPLACE (strftime(utc, '%Y-%m-%d %H:%M:%S') AS utc) FROM v",
    "value_summary": f"""WITH {_HOURS} SELECT strftime(min(utc), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(max(utc), '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS hours, round(100.0 * count(*) / (date_diff('hour', min(utc), max(utc)) + 1), 6) AS coverage_pct,
  round(avg(round(energy_price, 4)), 6) AS mean_energy_price, round(avg(round(tou_wedge, 4)), 6) AS mean_wedge FROM v""",
    "value_by_period": f"WITH {_HOURS} SELECT ulo_period AS period, round(avg(ulo_wedge), 6) AS mean_wedge, count(*) AS hours FROM v WHERE ulo_period IS NOT NULL GROUP BY 1",
    "polygon_to_nearest_point": f"""WITH {_PLACED} SELECT licence_no, "Location", round(distance, 6) AS distance FROM far WHERE distance <= 30000 QUALIFY row_number() OVER (PARTITION BY licence_no ORDER BY distance, "Location") = 1""",
    "locational_signal": f"""WITH {_PLACED},
st AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(28,4))) AS DOUBLE) / count(*) AS m, count(*) AS n FROM orders GROUP BY 1),
own AS (SELECT far.*, m / 20000 AS p, m / 50000 AS g, n / 10 AS l FROM far JOIN st ON c_custkey = o_custkey WHERE kind IN ('load', 'bus')),
ins AS (SELECT * FROM own WHERE distance = 0),
kinds AS (SELECT licence_no, string_agg(kind || ':' || n, ', ' ORDER BY n DESC, kind) AS node_types FROM (SELECT licence_no, kind, count(*) AS n FROM ins GROUP BY 1, 2) GROUP BY 1),
span AS (SELECT a.licence_no, max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) / 1000 AS span_km FROM ins a JOIN ins b USING (licence_no) GROUP BY 1),
agg AS (SELECT licence_no, count(*) AS n_nodes, string_agg("Location", '; ' ORDER BY "Location") AS node_names, avg(p) AS p, CASE WHEN count(*) > 1 THEN stddev_samp(p) END AS sd, avg(g) AS g, avg(l) AS l FROM ins GROUP BY 1),
near AS (SELECT * FROM own WHERE distance <= 30000 AND licence_no NOT IN (SELECT licence_no FROM ins) QUALIFY row_number() OVER (PARTITION BY licence_no ORDER BY distance, "Location") = 1),
u AS (SELECT licence_no, n_nodes, node_names, node_types, 'in_polygon' AS method, 0.0::DOUBLE AS distance_km, p, sd, g, l, span_km FROM agg JOIN kinds USING (licence_no) JOIN span USING (licence_no)
  UNION ALL SELECT licence_no, 1, "Location", kind, 'nearest_within_30km', round(distance / 1000, 2), p, NULL, g, l, 0.0 FROM near)
SELECT licence_no, n_name AS utility_name, coalesce(n_nodes, 0) AS n_nodes, coalesce(node_names, '') AS node_names, coalesce(node_types, '') AS node_types, coalesce(method, 'none') AS method, distance_km, coalesce(sd > 1, false) OR coalesce(span_km > 100, false) AS heterogeneous,
  round(p, 6) AS mean_premium, round(sd, 6) AS std_premium, round(g, 6) AS mean_congestion, round(l, 6) AS mean_loss, round(span_km, 6) AS span_km FROM box LEFT JOIN u USING (licence_no)""",
    "signal_changes": """WITH m AS (SELECT s_nationkey AS licence_no, CAST(sum(CAST(s_acctbal AS DECIMAL(28,4))) AS DOUBLE) / count(*) AS before, CAST(sum(CAST(s_acctbal AS DECIMAL(28,4))) FILTER (s_acctbal > 0) AS DOUBLE) / count(*) FILTER (s_acctbal > 0) AS after FROM supplier GROUP BY 1)
SELECT licence_no, before, after FROM m WHERE abs(after - before) > 500""",
    "weight_overrides": f"""WITH v AS (SELECT l_returnflag, s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), o AS (SELECT * FROM (VALUES {', '.join(map(str, WEIGHTS))}) AS t(f, z, w))
SELECT l_returnflag, s_nationkey, n AS n_nodes, n / sum(n) OVER (PARTITION BY l_returnflag) AS weight, 'votes' AS method FROM v WHERE l_returnflag NOT IN (SELECT f FROM o) UNION ALL SELECT f, z, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM v WHERE l_returnflag = f), 0), CAST(w AS DOUBLE), 'override' FROM o""",
    "primary_zone": "SELECT l_partkey, s_nationkey AS primary_zone FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, s_nationkey) = 1",
    "merge_old_and_new": """WITH e AS (SELECT *, ts >= TIMESTAMP '2024-01-15' AS new FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts >= TIMESTAMP '2024-01-15' DESC, event_id DESC) = 1)
SELECT user_id, event_type, event_id, value, CASE WHEN NOT new THEN props END AS props FROM e WHERE ts >= TIMESTAMP '2024-01-05'""",
    "file_per_date": f"SELECT date, name FROM ({_FILE}) QUALIFY row_number() OVER (PARTITION BY date ORDER BY v = 0 DESC, v DESC) = 1",
    "newest_file": f"SELECT name FROM ({_FILE}) ORDER BY date DESC, v = 0 DESC, v DESC LIMIT 1",
    "changed_files": "SELECT CAST(o_orderkey AS VARCHAR) AS name, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders WHERE o_orderstatus IN ('F', 'P')",
    "duplicate_keys": "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1",
    "parsed_numbers": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0::DOUBLE ELSE o_totalprice END AS total FROM orders",
    "station_zone_match": "SELECT c_custkey, 'Z' || (s_nationkey % 5) AS zone, s_name || ' TS' AS matched_station, CASE WHEN s_name IS NULL THEN 'unmatched' ELSE 'station_prefix' END AS zone_method FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND s_suppkey % 4 <> 0",
    "rebuilt_areas": f"{_SPARED} SELECT licence_no, difference, n AS n_source_features FROM x",
    "worst_area": f"{_SPARED} SELECT licence_no, difference FROM x ORDER BY difference DESC, licence_no DESC LIMIT 1",
    "geometry_problems": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'open ring' WHEN 2 THEN 'ring of fewer than four points' WHEN 3 THEN 'ring touches itself' ELSE 'empty' END AS problems FROM part",
    "repaired_polygons": """SELECT p_partkey, CASE p_partkey % 8 WHEN 7 THEN NULL ELSE p_partkey % 8 > 0 END AS repaired, CAST(([12, 8, 16, 75, 24, 0, 16, NULL])[p_partkey % 8 + 1] AS DOUBLE) AS area,
  ([1, 2, 1, 1, 2, 0, 2, NULL])[p_partkey % 8 + 1] AS n_polygons, ([2, 2, 1, 2, 2, 0, 2, NULL])[p_partkey % 8 + 1] AS n_rings FROM part""",
    "dissolved_overlaps": """SELECT 'N' || c_nationkey AS area_of, count(*) AS n_source_features, CAST(count(*) * 10000 - (count(*) - 1) * 3600 AS DOUBLE) AS area FROM customer GROUP BY 1
UNION ALL SELECT c_mktsegment, count(*), CAST(count(*) * 50 AS DOUBLE) FROM customer GROUP BY 1""",
    "points_in_areas": """WITH a AS (SELECT n_nationkey, pow(2, n_nationkey % 15) AS h FROM nation), p AS (SELECT o_orderkey, greatest(abs(o_orderkey * 37 % 6007 - 3000), abs(o_orderkey * 91 % 4001 - 2000)) AS far FROM orders)
SELECT n_nationkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM a JOIN p ON far <= h AND far >= h / 4 GROUP BY 1""",
    "projection_round_trip": f"WITH p AS (SELECT c_custkey AS c, {base._at('c_custkey')} FROM customer), {_conic_sql()}",
    "zonal_window_mean": f"""WITH d AS ({base._DAILY}), w AS (SELECT * FROM d WHERE date > (SELECT max(date) FROM d) - 400), z AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, floor(CAST(sum(CAST(o_totalprice AS DECIMAL(28,4))) AS DOUBLE) / count(*)) AS price FROM orders GROUP BY 1)
SELECT node_id, CAST(sum(n_hours) AS BIGINT) AS hours, CAST(coalesce(sum(n_hours) FILTER (price IS NOT NULL), 0) AS BIGINT) AS known_hours, round(CAST(sum(CAST(sp + price * n_hours AS DECIMAL(28,8))) AS DOUBLE) / sum(n_hours), 6) AS mean_lmp FROM w LEFT JOIN z USING (date) GROUP BY 1""",
    "holiday_orders": """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS t FROM orders), k AS (SELECT t, month(t) AS m, day(t) AS d, dayofweek(t) = 1 AS monday FROM o)
SELECT CASE WHEN m = 1 AND d = 1 THEN 'New Year''s Day' WHEN m = 2 AND monday AND d BETWEEN 15 AND 21 THEN 'Family Day' WHEN t IN ('1995-04-14', '1996-04-05', '1997-03-28', '1998-04-10', '1999-04-02', '2000-04-21', '2001-04-13') THEN 'Good Friday'
  WHEN m = 5 AND monday AND d BETWEEN 18 AND 24 THEN 'Victoria Day' WHEN m = 7 AND d = 1 THEN 'Canada Day' WHEN m = 8 AND monday AND d <= 7 THEN 'Civic Holiday' WHEN m = 9 AND monday AND d <= 7 THEN 'Labour Day' WHEN m = 10 AND monday AND d BETWEEN 8 AND 14 THEN 'Thanksgiving Day'
  WHEN m = 12 AND d = 25 THEN 'Christmas Day' WHEN m = 12 AND d = 26 THEN 'Boxing Day' END AS name, count(*) AS n FROM k GROUP BY 1 HAVING name IS NOT NULL""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in ORACLE}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
