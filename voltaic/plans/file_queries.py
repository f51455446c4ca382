"""Queries through files: the driver's whole tables are written in the formats of the inputs, and read again.

Each has the same rows as SQL on the tables. Files go to a new folder in the shared one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, overlay, stats
from ..operators import inputs, value, zones
from ..session import shared_folder
from ..sources import counts, readers, sinks, versions
from . import area_queries as areas
from . import queries as base
from .queries import customer, events, lineitem, nation, orders, part, supplier

FUELS = ("view", "signup", "click", "error", "purchase")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _tag(name: str, *inner: Column | str) -> Column:
    """An XML element around texts."""
    return F.concat(F.lit(f"<{name}>"), *[F.lit(x) if isinstance(x, str) else x for x in inner], F.lit(f"</{name}>"))


def _joined(order: str, text: Column, separator: str = "") -> Column:
    """The group's texts in this order, as one."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda s: s["t"]), separator)


def _documents(df: DataFrame, folder: str, key: str, text: str) -> str:
    """A file for each row of df, in a folder by key."""
    df.select(key, F.col(text).alias("value")).write.partitionBy(key).text(folder)
    return f"{folder}/*/*.txt"


def _lines(df: DataFrame, folder: str, key: str, order: list[str], line: str) -> str:
    """A file for each key of the rows' lines in order, in a folder by key; sorted outside memory, so a file may be of any size."""
    df.repartition(key).sortWithinPartitions(key, *order, line).select(key, F.col(line).alias("value")).write.partitionBy(key).text(folder)
    return f"{folder}/*/*.txt"


def _when(instant: str) -> Column:
    return F.date_format(instant, "yyyy-MM-dd HH:mm:ss").alias("utc")


def csv_round_trip(spark, d):
    folder = _scratch(spark)
    sinks.write_csv(customer(spark, d), folder, ["c_name", "c_custkey", "c_acctbal"], ["c_custkey"])
    return readers.csv_table(spark, folder, "c_name string, c_custkey long, c_acctbal double").select("c_custkey", "c_acctbal")


def zonal_xml_prices(spark, d):
    """Purchases of an hour as its price; every fifth hour has none."""
    e = events(spark, d).where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day"), (F.hour("ts") + 1).alias("he")).agg(stats.exact_sum(F.col("value")).alias("price"))
    hour = _tag("HourlyPriceComponents", _tag("PricingHour", F.col("he").cast("string")), _tag("ZonalPrice", F.when(F.col("he") % 5 == 0, " ").otherwise(F.col("price").cast("string"))))
    docs = e.groupBy("day").agg(_joined("he", hour).alias("hours")).select("day", _tag("Document", _tag("DocBody", _tag("DeliveryDate", F.col("day").cast("string")), F.col("hours"))).alias("doc"))
    return readers.zonal_prices(spark, _documents(docs, _scratch(spark), "day", "doc")).select(_when("timestamp_utc"), "price")


def fuel_xml_output(spark, d):
    """Kinds of events as fuels; sign-ups are the pseudo fuel that readers leave out."""
    e = events(spark, d).groupBy(F.to_date("ts").alias("day"), (F.hour("ts") + 1).alias("he"), "event_type").agg(stats.exact_sum(F.col("value")).alias("mw"))
    name = F.when(F.col("event_type") == "signup", "CONTROL_ACTIONS").otherwise(F.concat(F.upper("event_type"), F.lit(" PLANT")))
    fuel = _tag("FuelTotal", _tag("Fuel", name), _tag("EnergyValue", F.when(F.col("mw") > 5, _tag("Output", F.col("mw").cast("string"))).otherwise("<OutputQuality>-1</OutputQuality>")))
    hours = e.groupBy("day", "he").agg(_joined("event_type", fuel).alias("fuels")).select("day", "he", _tag("HourlyData", _tag("Hour", F.col("he").cast("string")), F.col("fuels")).alias("hour"))
    docs = hours.groupBy("day").agg(_joined("he", F.col("hour")).alias("hours")).select("day", _tag("Document", _tag("DocBody", _tag("DailyData", _tag("Day", F.col("day").cast("string")), F.col("hours")))).alias("doc"))
    own = [f"{f}_plant" for f in FUELS if f != "signup"]
    return readers.fuel_mix(spark, _documents(docs, _scratch(spark), "day", "doc"), own).select(_when("timestamp_utc"), *own)


def _rates(spark, d) -> str:
    """Orders as rows of hourly rates, a file a year whose rate column has one of two names; some rates are blank, some hours are none."""
    k = F.col("o_orderkey")
    hour = F.when(k % 41 == 0, "x").otherwise((k % 24 + 1).cast("string"))
    rows = orders(spark, d).select(F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), hour.alias("Hour"), F.concat("o_orderstatus", F.lit(', "'), "o_orderpriority", F.lit('"')).alias("Status"), F.when(k % 7 != 0, F.col("o_totalprice").cast("string")).alias("rate"))
    folder = _scratch(spark)
    for odd, name in ((0, "LFDA Rate ($/MWh)"), (1, "LFDC Rate ($/MWh)")):
        own = rows.where(F.col("year") % 2 == odd).withColumnRenamed("rate", name)
        own.repartition("year").write.mode("append").option("header", True).option("escape", '"').partitionBy("year").csv(folder)
    return f"{folder}/*/*.csv"


def rate_csv_rows(spark, d):
    return readers.adjustment_rates(spark, _rates(spark, d)).select(_when("timestamp_utc"), "rate", "status")


def rate_blanks(spark, d):
    return readers.blank_rates(spark, _rates(spark, d)).agg(F.count("*").alias("files"), F.sum("n_blank").alias("n_blank"))


def nodal_csv_prices(spark, d):
    """A month's order lines as a day's file with a preamble."""
    lines = lineitem(spark, d).select(F.date_trunc("month", "l_shipdate").cast("date").alias("day"), "l_suppkey", "l_linenumber", "l_orderkey", "l_quantity", F.nullif("l_tax", F.lit(0.0)).alias("loss"), F.nullif("l_discount", F.lit(0.0)).alias("congestion"))
    text = F.concat_ws(",", (F.col("l_linenumber") % 24 + 1).cast("string"), F.concat(F.lit("N"), F.col("l_suppkey").cast("string")), F.col("l_quantity").cast("string"), F.coalesce(F.col("loss").cast("string"), F.lit("")), F.coalesce(F.col("congestion").cast("string"), F.lit("")))
    head = F.array(F.concat(F.lit("CREATED AT 2026/01/01 12:00:00 FOR "), F.date_format("day", "yyyy/MM/dd")), F.lit("Delivery Hour,Pricing Location,LMP,Energy Loss Price,Energy Congestion Price"))
    heads = lines.select("day").distinct().select("day", F.posexplode(head).alias("nth", "line"), F.lit(0).cast("long").alias("key"))
    read = readers.nodal_prices(spark, _lines(heads.unionByName(lines.select("day", F.lit(2).alias("nth"), text.alias("line"), F.col("l_orderkey").cast("long").alias("key"))), _scratch(spark), "day", ["nth", "key"], "line"))
    return read.groupBy("node_id", F.date_format("date", "yyyy-MM-dd").alias("date"), _when("timestamp_utc")).agg(F.count("*").alias("n"), F.sum("lmp").cast("long").alias("lmp"), F.count("loss").alias("n_loss"), F.count("congestion").alias("n_congestion"))


def _regulator(spark, d) -> str:
    """Suppliers as a regulator's records, a file a nation; elements that are zero or empty are left out."""
    s, k = supplier(spark, d), F.col("s_suppkey")
    former = F.when(k % 3 == 0, _tag("Historical_Company_Name", "Old ", F.col("s_name"))).otherwise("")
    record = _tag("tab1", _tag("Current_Company_Name", F.col("s_name")), former, F.when(k % 4 != 0, _tag("Capacity", F.col("s_acctbal").cast("string"))).otherwise(""))
    docs = s.groupBy("s_nationkey").agg(_joined("s_suppkey", record).alias("rows")).select("s_nationkey", _tag("dataroot", F.col("rows")).alias("doc"))
    return _documents(docs, _scratch(spark), "s_nationkey", "doc")


def regulator_xml_rows(spark, d):
    table = readers.regulator_table(spark, _regulator(spark, d), "tab1", [])
    return table.select(F.col("Current_Company_Name").alias("name"), F.col("Historical_Company_Name").alias("former"), F.col("Capacity").cast("double").alias("capacity"))


def regulator_xml_names(spark, d):
    current, former = readers.regulator_names(spark, _regulator(spark, d))
    return current.select("name", F.lit(None).cast("string").alias("former")).unionByName(former)


def geojson_areas(spark, d):
    folder = _scratch(spark)
    sinks.write_features(areas._layer(spark, d).withColumn("n", F.lit(2)), folder, 3)
    return readers.geojson(spark, folder).select("licence_no", "utility_name", "n", geo.area(F.col("geometry")).alias("area"))


def log_namespaces(spark, d):
    """Counts of orders by status as the log of each priority; priorities from 3 on are logged again, without those that are open."""
    o = orders(spark, d)

    def entries(rows: DataFrame, action: str) -> DataFrame:
        return rows.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("count")).select(F.lit("1").alias("phase"), F.col("o_orderpriority").alias("dataset"), F.lit(action).alias("action"), F.col("o_orderstatus").alias("record_id"), "count", F.lit("orders").alias("note"))

    path = _scratch(spark)
    sinks.log_rows(entries(o, "first"), path)
    sinks.log_rows(entries(o.where("o_orderpriority >= '3' and o_orderstatus <> 'O'"), "second"), path)
    return sinks.read_log(spark, path)


def listing_digests(spark, d):
    rows = supplier(spark, d).groupBy("s_nationkey").agg(_joined("s_suppkey", F.col("s_name"), ";").alias("names"))
    files = _documents(rows, _scratch(spark), "s_nationkey", "names")
    return readers.listing(spark, files).select("sha256", "size")


def index_page_links(spark, d):
    """Orders as files of a directory page for each day, some of another feed."""
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 3 == 0, "PUB_Other_").otherwise("PUB_Price_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_v"), (k % 12).cast("string"), F.lit(".xml"))
    pages = orders(spark, d).select(F.to_date("o_orderdate").alias("day"), F.concat(F.lit('<tr><td><a href="'), name, F.lit('">x</a></td></tr>')).alias("link"), "o_orderkey").groupBy("day").agg(_joined("o_orderkey", F.col("link"), "\n").alias("html"))
    return readers.index_links(pages, "PUB_Price_")


def newest_vintage(spark, d):
    """A customer's orders as links to a dataset: the newest year's, names that start with "ED " first."""
    k = F.col("o_orderkey")
    links = orders(spark, d).select(F.col("o_custkey").cast("string").alias("dataset"), F.date_format("o_orderdate", "yyyy").alias("vintage"), F.concat(F.when(k % 2 == 0, "ED ").otherwise("file "), k.cast("string")).alias("name"), F.format_string("u%012d", k).alias("url"))
    return readers.newest_datasets(links)


def csv_row_counts(spark, d):
    """Customers as CSV files with line ends, quotes and blank rows in them."""
    k = F.col("c_custkey")
    note = F.when(k % 5 == 0, F.concat(F.lit('a\n"'), "c_name", F.lit('",\n'))).when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment"))
    folder = _scratch(spark)
    customer(spark, d).select("c_nationkey", k.cast("string").alias("key"), note.alias("note")).repartition("c_nationkey").write.option("header", True).option("escape", '"').partitionBy("c_nationkey").csv(folder)
    counted = counts.row_counts(spark, folder)
    return counted.agg(F.sum("n_rows").alias("n_rows"))


def swapped_table(spark, d):
    """Orders kept as a table of versions: all of them, then what is left without the open ones, then with every key once more."""
    path = _scratch(spark)
    now = versions.replace(orders(spark, d).select("o_orderkey", "o_orderstatus"), path)
    now = versions.replace(now.where("o_orderstatus <> 'O'"), path)
    now = versions.replace(now.unionByName(now), path)
    versions.vacuum(spark, path, 1)
    return versions.current(spark, path).groupBy("o_orderkey").agg(F.count("*").alias("n"))


def expected_one(spark, d):
    return inputs.expect_one(spark.read.parquet(f"{d}/region.parquet"), "r_name", "merica").select("r_regionkey", "r_name")


def coverage_decision(spark, d):
    """Do enough customers have a nation with suppliers to aggregate by nation?"""
    held = supplier(spark, d).select(F.col("s_nationkey").alias("zone")).where("zone % 6 <> 1").distinct()
    share, enough = zones.coverage(customer(spark, d).join(held, F.col("c_nationkey") == F.col("zone"), "left"))
    return spark.createDataFrame([(round(share, 9), enough)], "share double, enough boolean")


def solar_gate(spark, d):
    return value.check_solar_peak(areas._hourly(spark, d), "solar_mw", 0, 23).select("month", "hour")


def gap_of_days(spark, d):
    own = value.annual_gap(areas._hourly(spark, d), days=10)
    return own.select("hours", F.round("gap", 6).alias("gap"))


def simplified_rings(spark, d):
    """Rings with a corner that bulges by up to 60 and repeated points; what bulges by 30 or less goes."""
    k = F.col("p_partkey")
    bulge = (k % 7 * 10).cast("double")
    corners = [(F.lit(0.0), F.lit(0.0)), (F.lit(1000.0), bulge), (F.lit(2000.0), F.lit(0.0)), (F.lit(2000.00001), F.lit(0.0)), (F.lit(2000.0), F.lit(2000.0)), (F.lit(0.0), F.lit(0.0))]
    shape = F.array(F.array(F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners]))).cast(overlay.SHAPE)
    out = geo.tidy(geo.simplify(shape, 30.0))
    return part(spark, d).select("p_partkey", F.size(F.flatten(F.flatten(out))).alias("n_points"))


_RATE = "SELECT *, o_orderkey % 7 = 0 AS blank, o_orderkey % 41 = 0 AS odd, year(o_orderdate) AS y FROM orders"
ORACLE = {
    "csv_round_trip": "SELECT c_custkey, c_acctbal FROM customer",
    "zonal_xml_prices": f"SELECT strftime({base._UTC}, '%Y-%m-%d %H:%M:%S') AS utc, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS price FROM events WHERE event_type = 'purchase' AND (hour(ts) + 1) % 5 <> 0 GROUP BY 1",
    "fuel_xml_output": f"""WITH s AS (SELECT {base._UTC} AS u, event_type AS t, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS mw FROM events GROUP BY 1, 2)
SELECT strftime(u, '%Y-%m-%d %H:%M:%S') AS utc, {', '.join(f"max(mw) FILTER (t = '{f}') AS {f}_plant" for f in FUELS if f != 'signup')} FROM s WHERE mw > 5 AND t <> 'signup' GROUP BY 1""",
    "rate_csv_rows": f"""SELECT strftime(date_trunc('day', o_orderdate) + to_hours(CAST(o_orderkey % 24 + 5 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS utc, o_totalprice AS rate, o_orderstatus || ', "' || o_orderpriority || '"' AS status FROM ({_RATE}) WHERE NOT blank AND NOT odd""",
    "rate_blanks": f"SELECT count(DISTINCT y) AS files, CAST(count(*) AS BIGINT) AS n_blank FROM ({_RATE}) WHERE blank",
    "nodal_csv_prices": """SELECT 'N' || l_suppkey AS node_id, strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS date, strftime(date_trunc('month', l_shipdate) + to_hours(CAST(l_linenumber % 24 + 5 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS utc, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS lmp,
  count(nullif(l_tax, 0)) AS n_loss, count(nullif(l_discount, 0)) AS n_congestion FROM lineitem GROUP BY 1, 2, 3""",
    "regulator_xml_rows": "SELECT s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'Old ' || s_name END AS former, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS capacity FROM supplier",
    "regulator_xml_names": "SELECT DISTINCT s_name AS name, NULL::VARCHAR AS former FROM supplier UNION ALL SELECT s_name, 'Old ' || s_name FROM supplier WHERE s_suppkey % 3 = 0",
    "geojson_areas": "SELECT 'ED-2000-' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS licence_no, n_name AS utility_name, '2' AS n, (n_nationkey + 1) * 500000.0::DOUBLE AS area FROM nation",
    "log_namespaces": """SELECT '1' AS phase, o_orderpriority AS dataset, CASE WHEN o_orderpriority >= '3' THEN 'second' ELSE 'first' END AS action, o_orderstatus AS record_id, count(*) AS count, 'orders' AS note FROM orders WHERE o_orderpriority < '3' OR o_orderstatus <> 'O' GROUP BY ALL""",
    "listing_digests": "SELECT sha256(names) AS sha256, strlen(names) AS size FROM (SELECT string_agg(s_name, ';' ORDER BY s_suppkey) || chr(10) AS names FROM supplier GROUP BY s_nationkey)",
    "index_page_links": "SELECT DISTINCT 'PUB_Price_' || strftime(o_orderdate, '%Y%m%d') || '_v' || (o_orderkey % 12) || '.xml' AS name FROM orders WHERE o_orderkey % 3 <> 0",
    "newest_vintage": "SELECT CAST(o_custkey AS VARCHAR) AS dataset, 'u' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS url FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderkey % 2, o_orderkey DESC) = 1",
    "csv_row_counts": "SELECT CAST(count(*) AS BIGINT) AS n_rows FROM customer",
    "swapped_table": "SELECT o_orderkey, CAST(2 * count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1",
    "expected_one": "SELECT r_regionkey, r_name FROM region WHERE lower(r_name) LIKE '%merica%'",
    "coverage_decision": "WITH z AS (SELECT DISTINCT s_nationkey AS z FROM supplier WHERE s_nationkey % 6 <> 1), s AS (SELECT count(z) / count(*) AS share FROM customer LEFT JOIN z ON c_nationkey = z) SELECT round(share, 9) AS share, share >= 0.9 AS enough FROM s",
    "solar_gate": f"""WITH {areas._HOURS}, m AS (SELECT strftime((utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/Toronto', '%Y-%m') AS month, hour((utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/Toronto') AS hour, CAST(sum(CAST(solar_mw AS DECIMAL(28,4))) AS DOUBLE) / count(*) AS mean FROM v GROUP BY 1, 2)
SELECT month, hour FROM m QUALIFY row_number() OVER (PARTITION BY month ORDER BY mean DESC, hour) = 1""",
    "gap_of_days": f"WITH {areas._HOURS} SELECT count(*) AS hours, CASE WHEN count(*) >= 240 THEN round(sum(solar_mw * (tou_offset - energy_price)) / nullif(sum(solar_mw * tou_offset), 0), 6) END AS gap FROM v WHERE tou_offset IS NOT NULL",
    "simplified_rings": "SELECT p_partkey, CASE WHEN p_partkey % 7 * 10 > 30 THEN 5 ELSE 4 END AS n_points FROM part",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in ORACLE}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
