"""The locational signal of a service area: aggregation of its nodes, approval by rule, overrides, review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spatial

#: Limits of the rules, and the text of an approval.
NEAREST_KM = 30.0
HETERO_STD, HETERO_SPAN_KM = 1.0, 100.0
CHANGE = 0.5
RULE = "rule: >=1 load node, in_polygon, not heterogeneous, adoption reported"


def type_breakdown(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """key, node_types: "load:3, bus:1", most frequent first."""
    per = rows.groupBy(key, kind).count()
    listed = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col(kind).alias("kind"))))  # kinds are few
    return per.groupBy(key).agg(F.array_join(F.transform(listed, lambda s: F.concat(s["kind"], F.lit(":"), (-s["n"]).cast("string"))), ", ").alias("node_types"))


def build(layer: DataFrame, nodes: DataFrame, stats: DataFrame, types: tuple[str, ...] = ("load",), cell: float = 20_000.0) -> DataFrame:
    """A row per area of layer(licence_no, utility_name, geometry) from nodes(Location, node_type, x, y) with stats(node, ..).

    Nodes in the area count equally; an area without one takes the nearest within 30 km; an area without that has
    method none. Standard deviations are of samples: null for one node, and a null is not heterogeneous.
    """
    own = nodes.where(F.col("node_type").isin(*types)).join(stats, F.col("Location") == F.col("node"))
    values = ["mean_premium", "mean_congestion", "mean_loss"]
    within = spatial.inside(own.select("Location", "node_type", *values, "x", "y"), layer.select("licence_no", "geometry"), cell).drop("geometry")
    aggs = within.groupBy("licence_no").agg(
        F.count_distinct("Location").alias("n_nodes"), F.array_join(F.array_sort(F.collect_set("Location")), "; ").alias("node_names"),
        F.avg("mean_premium").alias("mean_premium"), F.stddev_samp("mean_premium").alias("std_premium"), F.avg("mean_congestion").alias("mean_congestion"), F.avg("mean_loss").alias("mean_loss"),
    )
    found = aggs.join(type_breakdown(within, "licence_no", "node_type"), "licence_no").join(spatial.span_km(within, "licence_no"), "licence_no", "left")
    found = found.withColumn("method", F.lit("in_polygon")).withColumn("distance_km", F.lit(0.0))
    missing = layer.join(found, "licence_no", "left_anti")
    near = spatial.nearest(missing, own, "licence_no", "Location", NEAREST_KM * 1000).join(own.select("Location", "node_type", *values), "Location")
    near = near.select(
        "licence_no", F.lit(1).cast("long").alias("n_nodes"), F.col("Location").alias("node_names"), F.col("mean_premium"), F.lit(None).cast("double").alias("std_premium"), "mean_congestion", "mean_loss",
        F.col("node_type").alias("node_types"), F.lit(0.0).alias("span_km"), F.lit("nearest_within_30km").alias("method"), F.round(F.col("distance") / 1000, 2).alias("distance_km"),
    )
    out = layer.select("licence_no", "utility_name").join(found.unionByName(near), "licence_no", "left")
    out = out.withColumn("n_nodes", F.coalesce("n_nodes", F.lit(0))).withColumn("node_names", F.coalesce("node_names", F.lit(""))).withColumn("node_types", F.coalesce("node_types", F.lit(""))).withColumn("method", F.coalesce("method", F.lit("none")))
    return out.withColumn("heterogeneous", heterogeneous())


def heterogeneous():
    return F.coalesce(F.col("std_premium") > HETERO_STD, F.lit(False)) | F.coalesce(F.col("span_km") > HETERO_SPAN_KM, F.lit(False))


def approve(signal: DataFrame, adoption: DataFrame, overrides: DataFrame) -> DataFrame:
    """signal with owner_override, owner_status and status_reason; overrides win and say what the rule would be."""
    own = signal.join(adoption.select("licence_no", F.col("reported").alias("reported_")), "licence_no", "left").join(overrides.select("licence_no", "owner_override", F.col("reason").alias("reason_")), "licence_no", "left")
    problems = F.array_compact(
        F.array(
            F.when(F.col("n_nodes") == 0, F.lit("no load node within 30 km")),
            F.when(F.col("method") != "in_polygon", F.concat(F.lit("method="), F.col("method"))),
            F.when(F.col("heterogeneous"), F.lit("heterogeneous")),
            F.when(~F.coalesce("reported_", F.lit(False)), F.lit("no adoption data")),
        )
    )
    rule = F.when(F.size(problems) == 0, "approved").otherwise("rejected")
    reason = F.when(F.size(problems) == 0, RULE).otherwise(F.array_join(problems, "; "))
    told = F.concat(F.lit("owner_override="), F.col("owner_override"), F.lit(": "), F.coalesce("reason_", F.lit("")), F.lit(" (rule would be "), rule, F.lit(")"))
    out = own.withColumn("owner_status", F.coalesce("owner_override", rule)).withColumn("status_reason", F.coalesce(told, reason))
    return out.withColumn("owner_override", F.coalesce("owner_override", F.lit(""))).drop("reported_", "reason_")


def check_overrides(overrides: DataFrame) -> DataFrame:
    """The overrides, or ValueError: a licence twice, or a value besides approved and rejected."""
    bad = overrides.groupBy("licence_no").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("owner_override").isin("approved", "rejected"), F.lit(False))).alias("good")).where("n > 1 or not good").limit(5).collect()
    if bad:
        raise ValueError(f"malformed overrides: {[r[0] for r in bad]}")
    return overrides


def review(signal: DataFrame, adoption: DataFrame, n: int = 20) -> DataFrame:
    """The n areas with most customers, licence_no settling ties."""
    return signal.join(adoption.select("licence_no", "customers"), "licence_no").orderBy(F.desc_nulls_last("customers"), "licence_no").limit(n)


def changes(before: DataFrame, after: DataFrame, least: float = CHANGE) -> DataFrame:
    """Areas whose premium moves by more than `least` between two builds."""
    a, b = (t.select("licence_no", F.col("mean_premium").alias(n)) for t, n in ((before, "before"), (after, "after")))
    return a.join(b, "licence_no").where(F.abs(F.col("after") - F.col("before")) > least)
