"""Reconciling names: an ordered cascade of exact matches, and the longest prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LEAST_BASE, node_base, norm, station_base, without_parenthesis


def match_parts(parts: DataFrame, name: str, current: DataFrame, historical: DataFrame) -> DataFrame:
    """parts with matched and match_type: its name as it is, without a trailing parenthesis, as a former name, or not at all.

    current(name); historical(former, name). Two spellings that normalise alike are one, the least. Nothing fuzzy.
    """
    now = current.groupBy(norm(F.col("name")).alias("key_")).agg(F.min("name").alias("own_"))
    old = historical.groupBy(norm(F.col("former")).alias("key_")).agg(F.min("name").alias("own_"))
    key, bare = norm(F.col(name)), norm(without_parenthesis(F.col(name)))
    out = parts.withColumn("k1_", key).withColumn("k2_", F.when(bare != key, bare))
    out = out.join(now.toDF("k1_", "by_current"), "k1_", "left").join(now.toDF("k2_", "by_bare"), "k2_", "left").join(old.toDF("k1_", "by_former"), "k1_", "left")
    kind = F.when(F.col("by_current").isNotNull(), "exact_current").when(F.col("by_bare").isNotNull(), "parenthetical_stripped").when(F.col("by_former").isNotNull(), "exact_historical").otherwise("unmatched")
    return out.withColumn("matched", F.coalesce("by_current", "by_bare", "by_former")).withColumn("match_type", kind).drop("k1_", "k2_", "by_current", "by_bare", "by_former")


def cascade(features: DataFrame, key: str, name: str, current: DataFrame, historical: DataFrame) -> DataFrame:
    """Per feature rrr_names (array in the order of its |-separated parts) and match_type; a part without a match leaves none."""
    parts = features.select(key, F.posexplode(F.split(name, r"\|")).alias("at", "part")).withColumn("part", F.trim("part"))
    found = match_parts(parts, "part", current, historical)
    all_ = F.array_sort(F.collect_list(F.struct("at", "matched", "match_type")))
    per = found.groupBy(key).agg(all_.alias("all_"), F.bool_and(F.col("matched").isNotNull()).alias("whole_"))
    names = F.when(F.col("whole_"), F.transform("all_", lambda s: s["matched"])).otherwise(F.array().cast("array<string>"))
    kinds = F.array_join(F.array_distinct(F.transform("all_", lambda s: s["match_type"])), "+")
    return per.select(key, names.alias("rrr_names"), F.when(F.col("whole_"), kinds).otherwise("unmatched").alias("match_type"))


def station_bases(stations: DataFrame, order: str | None = None) -> DataFrame:
    """base, station, zone of the bases that one zone only claims; of its stations the last by order (or by name)."""
    own = stations.select(station_base(F.col("station_name")).alias("base"), F.col("station_name").alias("station"), F.col("electrical_zone").alias("zone"), (F.col(order) if order else F.col("station_name")).alias("order_"))
    per = own.groupBy("base").agg(F.count_distinct("zone").alias("zones_"), F.max_by(F.struct("station", "zone"), F.struct("order_", "station")).alias("own_"))
    return per.where("zones_ = 1").select("base", "own_.station", "own_.zone")


def longest_prefix(rows: DataFrame, text: Column, prefixes: DataFrame, prefix: str, least: int = LEAST_BASE) -> DataFrame:
    """rows with the columns of the longest prefix of text; null where none of `least` characters or more fits.

    Each row's prefixes are rows of their own, matched by equality, so the join shuffles by prefix instead of comparing
    every pair; the longest is an aggregation. The most prefixes a row can have is its text's length.
    """
    rest = [c for c in prefixes.columns if c != prefix]
    ids = rows.select(text.alias("text_")).distinct().where(F.length("text_") >= least)
    cuts = ids.withColumn("cut_", F.explode(F.transform(F.sequence(F.lit(least), F.length("text_")), lambda n: F.substring(F.col("text_"), F.lit(1), n))))
    table = prefixes.where(F.length(prefix) >= least).withColumnRenamed(prefix, "cut_")
    best = cuts.join(table, "cut_").groupBy("text_").agg(F.max_by(F.struct(F.col("cut_").alias(prefix), *rest), F.length("cut_")).alias("best_"))
    return rows.withColumn("of_", text).join(best, F.col("of_") == F.col("text_"), "left").drop("of_", "text_").select("*", "best_.*").drop("best_")


def match_zones(nodes: DataFrame, stations: DataFrame, node: str = "node_id") -> DataFrame:
    """nodes with zone, matched_station and zone_method (station_prefix or unmatched)."""
    out = longest_prefix(nodes, node_base(F.col(node)), station_bases(stations), "base")
    return out.withColumnRenamed("station", "matched_station").drop("base").withColumn("zone_method", F.when(F.col("zone").isNull(), "unmatched").otherwise("station_prefix"))
