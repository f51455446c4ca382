"""One query per operator family over the driver's tables, each with the same rows as SQL.

Sums that decide values are of decimals, so both engines give the same double whatever the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text, time
from ..operators import adoption, inputs, merge, names, nodal, signal, spatial, tariff, value, zones

#: The queries' own tariff, two terms of two plans: effective_from, effective_to, plan, season, period, day_type, start, end, cents.
TARIFF = [
    (a, b, plan, season, period, day, lo, hi, round(price + add, 1))
    for a, b, add in (("2023-11-01", "2024-01-14", 0.0), ("2024-01-15", "2024-01-29", 1.5))
    for plan, season, period, day, lo, hi, price in (
        ("TOU", "winter", "off_peak", "weekday", 0, 7, 8.7), ("TOU", "winter", "on_peak", "weekday", 7, 11, 18.2), ("TOU", "winter", "mid_peak", "weekday", 11, 17, 12.2), ("TOU", "winter", "on_peak", "weekday", 17, 19, 18.2),
        ("TOU", "winter", "off_peak", "weekday", 19, 24, 8.7), ("TOU", "winter", "off_peak", "weekend_holiday", 0, 24, 8.7), ("ULO", "winter", "ultra_low", "weekday", 0, 7, 2.8), ("ULO", "winter", "mid_peak", "weekday", 7, 16, 12.2),
        ("ULO", "winter", "on_peak", "weekday", 16, 21, 28.6), ("ULO", "winter", "mid_peak", "weekday", 21, 23, 12.2), ("ULO", "winter", "ultra_low", "weekday", 23, 24, 2.8), ("ULO", "winter", "ultra_low", "weekend_holiday", 0, 7, 2.8),
        ("ULO", "winter", "off_peak", "weekend_holiday", 7, 23, 8.7), ("ULO", "winter", "ultra_low", "weekend_holiday", 23, 24, 2.8),
    )
]
TARIFF_COLUMNS = "effective_from string, effective_to string, plan string, season string, period string, day_type string, start_hour int, end_hour int, commodity_c_per_kwh double"
HOLIDAYS = ("2024-01-01",)
PREFIXES = ("SUPPLIER0", "SUPPLIER00", "SUPPLIER0000", "SUPPLIER00001", "SUPPLIER000002", "CUST")
SQUARES = [(f"Z{i}", 10.0 * i, 5.0 * (i % 3), 10.0 * i + 12.0, 5.0 * (i % 3) + 20.0) for i in range(5)]
HOLE = (2.0, 2.0, 6.0, 6.0)
OVERRIDES = ((3, "rejected"), (7, "approved"), (11, "approved"))


def _read(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


orders, lineitem, events, part, supplier, customer, nation = (_read(t) for t in ("orders", "lineitem", "events", "part", "supplier", "customer", "nation"))


def tariffs(spark: SparkSession) -> DataFrame:
    raw = spark.createDataFrame(TARIFF, TARIFF_COLUMNS)
    return raw.withColumn("effective_from", F.col("effective_from").cast("date")).withColumn("effective_to", F.col("effective_to").cast("date"))


def holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h,) for h in HOLIDAYS], "date string")


def _instants(spark: SparkSession, d: str) -> DataFrame:
    """events with the UTC instant of their hour, their ts taken as market time."""
    e = events(spark, d)
    return e.withColumn("instant", time.hour_ending_utc(F.col("ts").cast("date"), F.hour("ts") + 1))


def merge_keep_last(spark, d):
    return merge.keep_last(events(spark, d).select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


def winner_per_key(spark, d):
    o = orders(spark, d).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return merge.winner(o, ["o_custkey"], F.col("o_orderstatus") == "F", F.col("o_totalprice"), -F.col("o_orderkey"))


def hour_ending_utc(spark, d):
    return _instants(spark, d).select("event_id", F.date_format("instant", "yyyy-MM-dd HH:mm:ss").alias("utc"))


def toronto_wall_clock(spark, d):
    out = time.with_wall_clock(_instants(spark, d), "instant", holidays(spark))
    return out.select("event_id", F.date_format("local_date", "yyyy-MM-dd").alias("local_date"), F.col("local_hour").cast("long").alias("local_hour"), "season", "day_type")


def tariff_interval_join(spark, d):
    hours = time.with_wall_clock(_instants(spark, d), "instant", holidays(spark)).select("event_id", "value", "local_date", "local_hour", "season", "day_type")
    priced = tariff.classify(hours, tariff.validate(tariffs(spark)))
    cost = F.col("value").cast("decimal(18,2)") * F.col("commodity_c_per_kwh").cast("decimal(8,1)")
    return priced.groupBy("plan", "period", "day_type").agg(F.count("*").alias("hours"), F.sum(cost).cast("double").alias("cost"), F.min("commodity_c_per_kwh").alias("least_price"), F.max("commodity_c_per_kwh").alias("most_price"))


def _daily(spark, d):
    """Suppliers as nodes, order lines as hours, a part's retail price as the zonal price; lines of small parts have none."""
    zonal = part(spark, d).where("p_size > 10").select(F.col("p_partkey").alias("timestamp_utc"), F.col("p_retailprice").alias("price"))
    lines = lineitem(spark, d).select(
        F.col("l_suppkey").alias("node_id"), F.date_trunc("month", "l_shipdate").cast("date").alias("date"), F.col("l_partkey").alias("timestamp_utc"),
        F.col("l_extendedprice").alias("lmp"), F.nullif("l_tax", F.lit(0.0)).alias("loss"), F.nullif("l_discount", F.lit(0.0)).alias("congestion"),
    )
    return nodal.compact_daily(lines, zonal)


def matched_hour_premium(spark, d):
    return _daily(spark, d).select(F.col("node_id").alias("node_id"), F.date_format("date", "yyyy-MM-dd").alias("date"), "mean_lmp_minus_ozp", "mean_loss", "mean_congestion", F.col("n_hours").cast("long").alias("n_hours"))


def hour_weighted_mean(spark, d):
    return nodal.window_means(_daily(spark, d), days=400, least_days=12).select("node_id", "n_days", "hours", "mean_premium", "mean_loss", "mean_congestion", "kept")


def outer_join_dropped(spark, d):
    return value.unmatched(orders(spark, d).select(F.col("o_custkey").alias("k")), customer(spark, d).where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


def name_cascade(spark, d):
    n = nation(spark, d)
    current = n.where("n_nationkey % 3 <> 0").select(F.initcap("n_name").alias("name"))
    historical = n.where("n_nationkey % 3 = 0").select(F.concat(F.lit("Old "), F.col("n_name")).alias("former"), F.concat(F.lit("New "), F.col("n_name")).alias("name"))
    kind = F.col("c_custkey") % 5
    asked = F.when(kind == 0, F.concat(F.lit("  "), F.upper("n_name"))).when(kind == 1, F.concat("n_name", F.lit(" (formerly X)"))).when(kind == 2, F.concat(F.lit("OLD  "), F.col("n_name"))).when(kind == 3, F.concat("n_name", F.lit(" Hydro"))).otherwise(F.col("n_name"))
    rows = customer(spark, d).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", asked.alias("asked"))
    return names.match_parts(rows, "asked", current, historical).select("c_custkey", "matched", "match_type")


def longest_prefix(spark, d):
    table = spark.createDataFrame([(p,) for p in PREFIXES], "prefix string")
    rows = supplier(spark, d).select("s_suppkey", "s_name")
    return names.longest_prefix(rows, text.alphanumeric(F.col("s_name")), table, "prefix").select("s_suppkey", "prefix")


def keyed_sum_latest_year(spark, d):
    o = adoption.latest_year(orders(spark, d).withColumn("Year", F.date_format("o_orderdate", "yyyy")))
    return o.groupBy("o_custkey").agg(stats.exact_sum(F.col("o_totalprice")).alias("total"), F.count("*").alias("n"))


def per_1000_metric(spark, d):
    per = customer(spark, d).groupBy("c_nationkey").agg(F.count("*").alias("customers"), stats.exact_sum(F.col("c_acctbal")).alias("balance"))
    return per.select("c_nationkey", "customers", (F.col("balance") / F.col("customers") * 1000).alias("per_1000"))


def crosscheck_ratio_flag(spark, d):
    def mw(df, key, v):
        return df.groupBy(F.col(key).alias("kind")).agg(stats.exact_sum(F.col(v)).alias("mw"))

    kinds = nation(spark, d).select(F.col("n_nationkey").alias("kind"))
    return adoption.crosscheck(mw(customer(spark, d), "c_nationkey", "c_acctbal").withColumn("mw", F.col("mw") / 15), mw(supplier(spark, d), "s_nationkey", "s_acctbal"), kinds)


def zone_weights(spark, d):
    lines = lineitem(spark, d).join(supplier(spark, d), F.col("l_suppkey") == F.col("s_suppkey")).select("l_returnflag", "s_nationkey")
    return zones.votes(lines, "l_returnflag", "s_nationkey")


def node_signal_agg(spark, d):
    s = supplier(spark, d)
    k = F.col("s_acctbal").cast("decimal(18,2)")
    agg = s.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.sum(k).alias("a"), F.sum(k * k).alias("b"), F.array_join(F.array_sort(F.collect_set("s_name")), "; ").alias("node_names"))
    var = (F.col("n") * F.col("b").cast("decimal(28,4)") - F.col("a").cast("decimal(18,2)") * F.col("a").cast("decimal(18,2)")).cast("double") / (F.col("n") * (F.col("n") - 1))
    agg = agg.withColumn("mean_premium", F.col("a").cast("double") / F.col("n")).withColumn("std_premium", F.when(F.col("n") > 1, F.sqrt(var) / 3000)).withColumn("span_km", F.lit(0.0))
    return agg.select("s_nationkey", "n", "node_names", "mean_premium", signal.heterogeneous().alias("heterogeneous"))


def rule_approval(spark, d):
    per = supplier(spark, d).groupBy("s_nationkey").agg(F.count("*").alias("n"), F.max("s_acctbal").alias("top"))
    own = nation(spark, d).join(per, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(
        F.col("n_nationkey").alias("licence_no"), F.coalesce("n", F.lit(0)).alias("n_nodes"), F.when(F.col("n_nationkey") % 4 == 0, "nearest_within_30km").otherwise("in_polygon").alias("method"),
        F.coalesce(F.col("top") > 9000, F.lit(False)).alias("heterogeneous"),
    )
    told = nation(spark, d).select(F.col("n_nationkey").alias("licence_no"), (F.col("n_nationkey") % 6 != 5).alias("reported"))
    overrides = spark.createDataFrame([(k, s, "owner") for k, s in OVERRIDES], "licence_no int, owner_override string, reason string")
    return signal.approve(own, told, overrides).select("licence_no", "owner_override", "owner_status", "status_reason")


def _places(df: DataFrame, key: str, name: str, step: float) -> DataFrame:
    """Coordinates from keys, for tables that have none."""
    k = F.col(key)
    return df.select(k.alias(name), ((k * 37) % 1000 / 100.0 - 84.0).alias("lon"), ((k * 91) % 700 / 100.0 * step + 43.0).alias("lat"))


def nearest_within_radius(spark, d):
    out = spatial.nearest_point(_places(customer(spark, d), "c_custkey", "c", 1.0), _places(supplier(spark, d), "s_suppkey", "s", 1.0), "c", "s", 60.0)
    return out.select("c", "s", F.floor(F.col("km") * 1000).alias("metres"))


def point_in_polygon(spark, d):
    def ring(x0, y0, x1, y1):
        return [{"x": x0, "y": y0}, {"x": x1, "y": y0}, {"x": x1, "y": y1}, {"x": x0, "y": y1}, {"x": x0, "y": y0}]

    shapes = [(z, [[ring(*box), ring(box[0] + HOLE[0], box[1] + HOLE[1], box[0] + HOLE[2], box[1] + HOLE[3])]]) for z, *box in SQUARES]
    polygons = spark.createDataFrame(shapes, f"zone string, geometry {'array<array<array<struct<x:double,y:double>>>>'}")
    points = part(spark, d).select("p_partkey", (F.col("p_partkey") % 601 / 10.0).alias("x"), (F.col("p_partkey") * 7 % 301 / 10.0).alias("y"))
    return spatial.inside(points, polygons, 10.0).select("p_partkey", "zone")


def sibling_quarantine(spark, d):
    nodes = _places(supplier(spark, d), "s_suppkey", "k", 1.0).select(F.concat(F.lit("STN"), (F.col("k") % 40).cast("string"), F.lit("-LT.T"), F.col("k").cast("string")).alias("Location"), F.col("lon").alias("Longitude"), F.col("lat").alias("Latitude"))
    out = spatial.quarantine(nodes, ("STN1-LT.T1",), 400.0)
    return out.select("Location", F.floor(F.col("km") * 1000).alias("metres"))


def percentile_clip(spark, d):
    return stats.clip_range(lineitem(spark, d), "l_extendedprice")


def spearman(spark, d):
    per = lineitem(spark, d).groupBy("l_suppkey").agg(F.count("*").alias("n_lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))
    both = supplier(spark, d).join(per, F.col("s_suppkey") == F.col("l_suppkey"))
    return stats.spearman(both, "s_acctbal", "n_lines").select(F.round("rho", 9).alias("rho"), "n")


def coverage_gaps(spark, d):
    own = events(spark, d).where("event_type = 'purchase' and value > 250")
    return stats.coverage_gaps(own, "ts", 0.9).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "status")


def top_n_by_metric(spark, d):
    rows = customer(spark, d).select(F.col("c_custkey").alias("licence_no"), F.col("c_acctbal").alias("customers"))
    return signal.review(rows.select("licence_no"), rows).select(F.col("licence_no").alias("c_custkey"), F.col("customers").alias("c_acctbal"))


def anti_unmatched(spark, d):
    open_ = orders(spark, d).where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return customer(spark, d).join(inputs.unmatched(customer(spark, d), open_, "c_custkey"), "c_custkey").select("c_custkey", "c_name")


#: Endings that the node-type query gives parts in turn, so that every rule is met.
UNITS = (":LMP", "", "-LT.G1", "-LT.BATT1", "-LT.AG", "-LT.T_DRA", "STRGE-LT.X", "-LT.SG12A", "-LT.G1_2", "-LT.LF")


def node_type_case(spark, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), (F.col("p_partkey") % len(UNITS) + 1).cast("int"))
    name = F.concat(F.regexp_replace(F.upper("p_type"), "[ .]", ""), unit)
    return part(spark, d).select("p_partkey", text.node_type(name).alias("node_type"), text.name_stem(name).alias("stem"))


def peak_hour_gate(spark, d):
    out = value.peak_hours(_instants(spark, d), "value", "instant")
    return out.select("month", F.col("hour").cast("long").alias("hour"))


def union_by_name_dedup(spark, d):
    a = supplier(spark, d).select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return a.unionByName(customer(spark, d).select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("nation"))).distinct()


_UTC = "date_trunc('hour', ts) + INTERVAL 5 HOUR"
_CLOCK = f"SELECT *, (({_UTC}) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Toronto' AS clock FROM events"
_TYPED = f"""SELECT *, CAST(clock AS DATE) AS local_date, hour(clock) AS local_hour, CASE WHEN month(clock) BETWEEN 5 AND 10 THEN 'summer' ELSE 'winter' END AS season,
  CASE WHEN dayofweek(clock) IN (0, 6) OR CAST(clock AS DATE) IN ({', '.join(f"DATE '{h}'" for h in HOLIDAYS)}) THEN 'weekend_holiday' ELSE 'weekday' END AS day_type FROM ({_CLOCK})"""
_TARIFF = "(VALUES " + ", ".join(f"(DATE '{a}', DATE '{b}', '{p}', '{s}', '{q}', '{t}', {lo}, {hi}, CAST({c} AS DOUBLE))" for a, b, p, s, q, t, lo, hi, c in TARIFF) + ") AS t(ef, et, plan, t_season, period, t_day, h0, h1, price)"
_DAILY = """SELECT l_suppkey AS node_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, count(*) AS n_hours,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4)) - CAST(p_retailprice AS DECIMAL(18,4))) AS DOUBLE) AS sp, CAST(sum(CAST(coalesce(nullif(l_tax, 0), 0) AS DECIMAL(18,4))) AS DOUBLE) AS sl,
  CAST(sum(CAST(coalesce(nullif(l_discount, 0), 0) AS DECIMAL(18,4))) AS DOUBLE) AS sc FROM lineitem JOIN part ON l_partkey = p_partkey AND p_size > 10 GROUP BY 1, 2"""


def _great_circle(a: str, b: str) -> str:
    return f"2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


def _at(key: str) -> str:
    return f"({key} * 37) % 1000 / 100.0 - 84.0 AS lon, ({key} * 91) % 700 / 100.0 * 1.0 + 43.0 AS lat"


def _boxes() -> str:
    return "(VALUES " + ", ".join(f"('{z}', {a}, {b}, {c}, {e})" for z, a, b, c, e in SQUARES) + ") AS z(zone, x0, y0, x1, y1)"


ORACLE = {
    "merge_keep_last": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "winner_per_key": "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey) = 1",
    "hour_ending_utc": f"SELECT event_id, strftime({_UTC}, '%Y-%m-%d %H:%M:%S') AS utc FROM events",
    "toronto_wall_clock": f"SELECT event_id, strftime(local_date, '%Y-%m-%d') AS local_date, CAST(local_hour AS BIGINT) AS local_hour, season, day_type FROM ({_TYPED})",
    "tariff_interval_join": f"SELECT plan, period, day_type, count(*) AS hours, CAST(sum(CAST(value AS DECIMAL(18,2)) * CAST(price AS DECIMAL(8,1))) AS DOUBLE) AS cost, min(price) AS least_price, max(price) AS most_price FROM ({_TYPED}) e JOIN {_TARIFF} ON e.season = t_season AND e.day_type = t_day AND local_hour >= h0 AND local_hour < h1 AND local_date BETWEEN ef AND et GROUP BY ALL",
    "matched_hour_premium": f"SELECT node_id, strftime(date, '%Y-%m-%d') AS date, sp / n_hours AS mean_lmp_minus_ozp, sl / n_hours AS mean_loss, sc / n_hours AS mean_congestion, n_hours FROM ({_DAILY})",
    "hour_weighted_mean": f"""WITH d AS ({_DAILY}), w AS (SELECT * FROM d WHERE date > (SELECT max(date) FROM d) - 400)
SELECT node_id, count(DISTINCT date) AS n_days, CAST(sum(n_hours) AS BIGINT) AS hours, CAST(sum(CAST(sp AS DECIMAL(28,4))) AS DOUBLE) / sum(n_hours) AS mean_premium, CAST(sum(CAST(sl AS DECIMAL(28,4))) AS DOUBLE) / sum(n_hours) AS mean_loss,
  CAST(sum(CAST(sc AS DECIMAL(28,4))) AS DOUBLE) / sum(n_hours) AS mean_congestion, count(DISTINCT date) >= 12 AS kept FROM w GROUP BY 1""",
    "outer_join_dropped": "SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (a IS NULL OR b IS NULL) AS dropped FROM (SELECT DISTINCT o_custkey AS a FROM orders) FULL JOIN (SELECT DISTINCT c_custkey AS b FROM customer WHERE c_acctbal > 0) ON a = b",
    "name_cascade": r"""WITH asked AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '  ' || upper(n_name) WHEN 1 THEN n_name || ' (formerly X)' WHEN 2 THEN 'OLD  ' || n_name WHEN 3 THEN n_name || ' Hydro' ELSE n_name END AS asked FROM customer JOIN nation ON c_nationkey = n_nationkey),
cur AS (SELECT lower(n_name) AS key, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS name FROM nation WHERE n_nationkey % 3 <> 0),
old AS (SELECT 'old ' || lower(n_name) AS key, 'New ' || n_name AS name FROM nation WHERE n_nationkey % 3 = 0),
keyed AS (SELECT c_custkey, regexp_replace(lower(trim(asked)), '\s+', ' ', 'g') AS k1, regexp_replace(lower(trim(regexp_replace(asked, '\s*\([^)]*\)\s*$', ''))), '\s+', ' ', 'g') AS k2 FROM asked)
SELECT c_custkey, coalesce(a.name, b.name, o.name) AS matched, CASE WHEN a.name IS NOT NULL THEN 'exact_current' WHEN b.name IS NOT NULL THEN 'parenthetical_stripped' WHEN o.name IS NOT NULL THEN 'exact_historical' ELSE 'unmatched' END AS match_type
FROM keyed LEFT JOIN cur a ON k1 = a.key LEFT JOIN cur b ON k2 = b.key AND k2 <> k1 LEFT JOIN old o ON k1 = o.key""",
    "longest_prefix": f"SELECT s_suppkey, (SELECT p FROM (VALUES {', '.join(f'({p!r})' for p in PREFIXES)}) AS t(p) WHERE length(p) >= 5 AND starts_with(regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g'), p) ORDER BY length(p) DESC LIMIT 1) AS prefix FROM supplier",
    "keyed_sum_latest_year": "SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(28,4))) AS DOUBLE) AS total, count(*) AS n FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) GROUP BY 1",
    "per_1000_metric": "SELECT c_nationkey, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(28,4))) AS DOUBLE) / count(*) * 1000 AS per_1000 FROM customer GROUP BY 1",
    "crosscheck_ratio_flag": """WITH r AS (SELECT c_nationkey AS kind, CAST(sum(CAST(c_acctbal AS DECIMAL(28,4))) AS DOUBLE) / 15 AS mw FROM customer GROUP BY 1), c AS (SELECT s_nationkey AS kind, CAST(sum(CAST(s_acctbal AS DECIMAL(28,4))) AS DOUBLE) AS mw FROM supplier GROUP BY 1),
x AS (SELECT n_nationkey AS kind, coalesce(r.mw, 0.0::DOUBLE) AS reported, coalesce(c.mw, 0.0::DOUBLE) AS contracted FROM nation LEFT JOIN r ON r.kind = n_nationkey LEFT JOIN c ON c.kind = n_nationkey)
SELECT kind, reported, contracted, CASE WHEN reported > 0 THEN contracted / reported END AS ratio, coalesce(abs(CASE WHEN reported > 0 THEN contracted / reported END - 1) > 0.2, false) AS flag FROM x""",
    "zone_weights": "SELECT l_returnflag, s_nationkey, count(*) AS n_nodes, count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "node_signal_agg": """WITH a AS (SELECT s_nationkey, count(*) AS n, string_agg(DISTINCT s_name, '; ' ORDER BY s_name) AS node_names, sum(CAST(s_acctbal AS DECIMAL(18,2))) AS a, stddev_samp(s_acctbal) AS sd FROM supplier GROUP BY 1)
SELECT s_nationkey, n, node_names, CAST(a AS DOUBLE) / n AS mean_premium, coalesce(sd / 3000 > 1.0, false) AS heterogeneous FROM a""",
    "rule_approval": f"""WITH per AS (SELECT s_nationkey, count(*) AS n, max(s_acctbal) AS top FROM supplier GROUP BY 1),
r AS (SELECT n_nationkey AS licence_no, list_filter([CASE WHEN n IS NULL THEN 'no load node within 30 km' END, CASE WHEN n_nationkey % 4 = 0 THEN 'method=nearest_within_30km' END, CASE WHEN coalesce(top > 9000, false) THEN 'heterogeneous' END, CASE WHEN n_nationkey % 6 = 5 THEN 'no adoption data' END], lambda x: x IS NOT NULL) AS p, o.s AS s
FROM nation LEFT JOIN per ON n_nationkey = s_nationkey LEFT JOIN (VALUES {', '.join(map(str, OVERRIDES))}) AS o(k, s) ON o.k = n_nationkey)
SELECT licence_no, coalesce(s, '') AS owner_override, coalesce(s, CASE WHEN len(p) = 0 THEN 'approved' ELSE 'rejected' END) AS owner_status,
  CASE WHEN s IS NOT NULL THEN 'owner_override=' || s || ': owner (rule would be ' || CASE WHEN len(p) = 0 THEN 'approved' ELSE 'rejected' END || ')' WHEN len(p) = 0 THEN '{signal.RULE}' ELSE array_to_string(p, '; ') END AS status_reason FROM r""",
    "nearest_within_radius": f"""WITH a AS (SELECT c_custkey AS c, {_at('c_custkey')} FROM customer), b AS (SELECT s_suppkey AS s, {_at('s_suppkey')} FROM supplier), x AS (SELECT c, s, {_great_circle('a', 'b')} AS km FROM a, b)
SELECT c, s, CAST(floor(km * 1000) AS BIGINT) AS metres FROM x WHERE km <= 60.0 QUALIFY row_number() OVER (PARTITION BY c ORDER BY km, s) = 1""",
    "point_in_polygon": f"""WITH p AS (SELECT p_partkey, p_partkey % 601 / 10.0 AS x, p_partkey * 7 % 301 / 10.0 AS y FROM part)
SELECT p_partkey, zone FROM p JOIN {_boxes()} ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND NOT (x > x0 + {HOLE[0]} AND x < x0 + {HOLE[2]} AND y > y0 + {HOLE[1]} AND y < y0 + {HOLE[3]})""",
    "sibling_quarantine": f"""WITH a AS (SELECT 'STN' || (s_suppkey % 40) || '-LT.T' || s_suppkey AS name, 'STN' || (s_suppkey % 40) AS stem, {_at('s_suppkey')} FROM supplier), g AS (SELECT a.name, min({_great_circle('a', 'b')}) AS km FROM a JOIN a b ON a.stem = b.stem AND a.name <> b.name GROUP BY 1)
SELECT a.name AS "Location", CAST(floor(km * 1000) AS BIGINT) AS metres FROM a LEFT JOIN g ON a.name = g.name WHERE km > 400.0 OR a.name = 'STN1-LT.T1'""",
    "percentile_clip": "SELECT quantile_cont(l_extendedprice, 0.02) AS lo, quantile_cont(l_extendedprice, 0.98) AS hi FROM lineitem",
    "spearman": """WITH per AS (SELECT l_suppkey, count(*) AS n_lines FROM lineitem GROUP BY 1), b AS (SELECT s_acctbal AS x, n_lines AS y FROM supplier JOIN per ON s_suppkey = l_suppkey),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM b)
SELECT round(corr(rx, ry), 9) AS rho, count(*) AS n FROM r""",
    "coverage_gaps": """WITH per AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 250 GROUP BY 1), f AS (SELECT median(n) AS m, min(day) AS a, max(day) AS b FROM per),
days AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day, m FROM f)
SELECT strftime(days.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' ELSE 'partial' END AS status FROM days LEFT JOIN per ON per.day = days.day WHERE n IS NULL OR n < 0.9 * m""",
    "top_n_by_metric": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20",
    "anti_unmatched": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "node_type_case": f"""WITH n AS (SELECT p_partkey, regexp_replace(upper(p_type), '[ .]', '', 'g') || ([{', '.join(repr(u) for u in UNITS)}])[p_partkey % {len(UNITS)} + 1] AS name FROM part),
s AS (SELECT *, split_part(name, '.', 1) AS station, CASE WHEN contains(name, '.') THEN substring(name, position('.' IN name) + 1) END AS unit FROM n)
SELECT p_partkey, CASE WHEN ends_with(name, ':LMP') THEN 'bus' WHEN unit IS NULL THEN 'load' WHEN contains(unit, '_DRA') THEN 'dra' WHEN contains(unit, 'BATT') OR contains(unit, 'STRG') OR contains(station, 'STRGE') THEN 'battery'
  WHEN regexp_full_match(unit, '(?:(?:ST|CT|GT|S|C)?G\\d+[A-Z]*|G\\d+_[A-Z0-9]+)') THEN 'generator' WHEN starts_with(unit, 'AG') OR starts_with(unit, 'APG') THEN 'aggregate' ELSE 'load' END AS node_type,
  regexp_replace(regexp_replace(regexp_replace(station, ':LMP$', ''), '-(LT|115|230|500)$', ''), '(GS|BESS\\d*|STRGE)$', '') AS stem FROM s""".replace("\\\\", "\\"),
    "peak_hour_gate": f"""WITH m AS (SELECT strftime(clock, '%Y-%m') AS month, hour(clock) AS hour, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) / count(*) AS mean FROM ({_CLOCK}) GROUP BY 1, 2)
SELECT month, CAST(hour AS BIGINT) AS hour FROM m QUALIFY row_number() OVER (PARTITION BY month ORDER BY mean DESC, hour) = 1""",
    "union_by_name_dedup": "SELECT s_nationkey AS nation, s_name AS name FROM supplier UNION SELECT c_nationkey, c_mktsegment FROM customer",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in ORACLE}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


