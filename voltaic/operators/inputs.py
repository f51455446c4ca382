"""Checks of supplied inputs: keys, sets, geometry; and areas rebuilt from their parts against those supplied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.overlay import GRID
from ..functions.overlay import repaired as repair
from ..schemas import SchemaError, require
from . import overlay


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def _refuse(rows: DataFrame, what: str) -> None:
    if bad := rows.limit(5).collect():
        raise SchemaError(f"{what}: {[tuple(r) for r in bad]}")


def nodes(raw: DataFrame) -> DataFrame:
    """node_id, lat, lon of a location table, or SchemaError: a column is missing, or a node is there twice."""
    require(raw, ["Longitude", "Latitude", "Location"], "nodes")
    out = raw.select(F.col("Location").alias("node_id"), F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"))
    _refuse(duplicates(out, "node_id"), "nodes twice")
    return out


def areas(layer: DataFrame) -> DataFrame:
    """The layer, or SchemaError: it is empty, a licence is there twice, or a geometry is unsound."""
    require(layer, ["licence_no", "geometry"], "areas")
    if layer.isEmpty():
        raise SchemaError("areas: no features")
    _refuse(duplicates(layer, "licence_no"), "licences twice")
    _refuse(layer.select("licence_no", geo.problems(F.col("geometry")).alias("p")).where(F.size("p") > 0), "unsound geometry")
    return layer


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of left that right lacks: priced nodes without coordinates, areas without a zone or signal."""
    return left.select(key).where(F.col(key).isNotNull()).distinct().join(right.select(key), key, "left_anti")


def qa_entries(rows: DataFrame, record: str, phase: str, dataset: str, action: str, note: str) -> DataFrame:
    """Log rows: one per record, and one with their number."""
    own = rows.select(F.col(record).cast("string").alias("record_id"), F.lit(1).cast("long").alias("count"))
    total = rows.agg(F.lit("total").alias("record_id"), F.count("*").alias("count"))
    return own.unionByName(total).select(F.lit(phase).alias("phase"), F.lit(dataset).alias("dataset"), F.lit(action).alias("action"), "record_id", "count", F.lit(note).alias("note"))


def same_keys(left: DataFrame, right: DataFrame, key: str) -> None:
    """SchemaError unless both tables have the same keys."""
    for a, b, what in ((left, right, "only on the left"), (right, left, "only on the right")):
        _refuse(unmatched(a, b, key), what)


def expect_one(df: DataFrame, name: str, part: str) -> DataFrame:
    """The one row whose name contains part, whatever the case; SchemaError for none or several."""
    found = df.where(F.contains(F.lower(name), F.lit(part.lower())))
    if (n := found.limit(2).count()) != 1:
        raise SchemaError(f"{n or 'no'} rows whose {name} contains {part!r}, where one is expected")
    return found


def dissolve(parts: DataFrame, key: str, *first: Column) -> DataFrame:
    """One multipolygon per key, the union of its parts, with their number and the first of other columns.

    Overlaps count once and shared borders go, so areas are those of what the parts cover.
    """
    facts = parts.groupBy(F.col(key).alias("of_")).agg(F.count("*").alias("n_source_features"), *first)
    return overlay.dissolve(parts, key).join(facts, F.col(key).eqNullSafe(F.col("of_"))).drop("of_")


def dissolve_disjoint(parts: DataFrame, key: str, *first: Column) -> DataFrame:
    """dissolve() for parts that are known not to overlap: their polygons side by side, without Python."""
    return parts.groupBy(key).agg(F.flatten(F.collect_list("geometry")).alias("geometry"), F.count("*").alias("n_source_features"), *first)


def repaired(layer: DataFrame, key: str = "licence_no", grid: float = GRID) -> tuple[DataFrame, DataFrame]:
    """The layer with sound geometries, and the keys of those that were not: the log's geometry_repaired rows."""
    own = layer.withColumn("sound_", repair(F.col("geometry"), grid))
    return own.withColumn("geometry", F.col("sound_.geometry")).drop("sound_"), own.where("sound_.repaired").select(key)


def compare_areas(rebuilt: DataFrame, supplied: DataFrame, key: str = "licence_no") -> DataFrame:
    """key, relative difference of areas (metres in), for tables of the same keys; the worst by max_by of it."""
    same_keys(rebuilt, supplied, key)
    a = rebuilt.select(key, geo.area(F.col("geometry")).alias("a"))
    b = supplied.select(key, geo.area(F.col("geometry")).alias("b"))
    return a.join(b, key).select(key, F.when(F.col("b") != 0, F.abs(F.col("a") - F.col("b")) / F.col("b")).alias("difference"))


def worst(differences: DataFrame, key: str = "licence_no") -> DataFrame:
    """The row of the greatest difference."""
    return differences.agg(F.max_by(key, F.struct("difference", key)).alias(key), F.max("difference").alias("difference"))
