"""Zones: coverage gates, votes as weights, overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_COVERAGE = 0.90


def coverage(assigned: DataFrame, zone: str = "zone") -> tuple[float, bool]:
    """Share of nodes with a zone, and whether that is enough to aggregate by zone. An empty table is not."""
    n, zoned = assigned.agg(F.count("*"), F.count(zone)).first()
    share = zoned / n if n else 0.0
    return share, share >= LEAST_COVERAGE


def votes(inside: DataFrame, group: str, zone: str) -> DataFrame:
    """group, zone, n_nodes, weight: each zone's share of a group's nodes; nodes without a zone have no vote."""
    per = inside.where(F.col(zone).isNotNull()).groupBy(group, zone).agg(F.count("*").alias("n_nodes"))
    return per.withColumn("weight", F.col("n_nodes") / F.sum("n_nodes").over(Window.partitionBy(group)))


def with_overrides(weights: DataFrame, overrides: DataFrame, group: str, zone: str) -> DataFrame:
    """weights, where groups in overrides(group, zone, weight) have theirs instead; node counts come from the votes, summed first, so rows don't multiply."""
    nodes = weights.groupBy(group).agg(F.sum("n_nodes").alias("n_nodes"))
    own = overrides.join(nodes, group, "left").select(group, zone, F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), "weight", F.lit("override").alias("method"))
    rest = weights.join(overrides.select(group).distinct(), group, "left_anti").withColumn("method", F.lit("votes"))
    return rest.select(*own.columns).unionByName(own)


def check_weights(weights: DataFrame, group: str, tolerance: float = 1e-9) -> DataFrame:
    """The weights, or ValueError where a group's don't add up to 1."""
    bad = weights.groupBy(group).agg(F.sum("weight").alias("w")).where(F.abs(F.col("w") - 1) > tolerance).limit(5).collect()
    if bad:
        raise ValueError(f"weights don't add up to 1: {[tuple(r) for r in bad]}")
    return weights


def primary(weights: DataFrame, group: str, zone: str) -> DataFrame:
    """group, primary zone: the one of greatest weight; of equals the first by name."""
    top = weights.groupBy(group, "weight").agg(F.min(zone).alias(zone))
    return top.groupBy(group).agg(F.max_by(zone, "weight").alias("primary_zone"))
