"""Sinks: the namespaced quality log, fixed-order CSV, JSON, GeoJSON and the manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import keep_last
from ..schemas import QA_LOG


def log_rows(entries: DataFrame, path: str) -> None:
    """Replace the (phase, dataset) namespaces of entries in the log table; others stay.

    All of a run's entries for a namespace go in one call, as a later call would replace them.
    """
    spark = entries.sparkSession
    columns = [x.split()[0] for x in QA_LOG.split(", ")]
    rows = entries.select(*columns).dropDuplicates()
    rows.repartition("phase", "dataset").sortWithinPartitions(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("phase", "dataset").parquet(path)
    spark.catalog.refreshByPath(path)


def read_log(spark, path: str) -> DataFrame:
    columns = [x.split()[0] for x in QA_LOG.split(", ")]
    return spark.read.schema(QA_LOG).parquet(path).select(*columns).orderBy("phase", "dataset", "action", "record_id")


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """Columns in this order, rows sorted; as many files as there are ranges, in order by name."""
    df.select(*columns).orderBy(*order).write.mode("overwrite").csv(path, header=True)


def one_row_json(df: DataFrame, path: str) -> dict:
    """A one-row table as a JSON object in a local file, for reports."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} rows where one is expected")
    out = rows[0].asDict(recursive=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=2, sort_keys=True, default=str)
    return out


def features(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """value: one GeoJSON feature per row, as text."""
    coordinates = F.transform(geometry, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"]))))
    shape = F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))
    props = F.struct(*[c for c in df.columns if c != geometry])
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), shape.alias("geometry"))).alias("value"))


def write_geojson(df: DataFrame, path: str, order: list[str], geometry: str = "geometry") -> None:
    """One FeatureCollection in a local file, written as rows stream in: for layers that a report shows."""
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for i, row in enumerate(features(df.orderBy(*order), geometry).toLocalIterator()):
            f.write(("," if i else "") + "\n" + row[0])
        f.write("\n]}\n")


def write_features(df: DataFrame, path: str, files: int, geometry: str = "geometry") -> None:
    """So many files (or fewer) in folders at path, each a FeatureCollection, written by as many tasks: for layers of any size."""
    own = features(df, geometry).select("value", F.pmod(F.xxhash64("value"), F.lit(files)).alias("file_"))
    whole = own.groupBy("file_").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list("value")), ","), F.lit("]}")).alias("value"))
    whole.select("file_", "value").write.mode("overwrite").partitionBy("file_").text(path)


def update_manifest(manifest: DataFrame, seen: DataFrame) -> DataFrame:
    """The manifest with the files just read in place of their former entries."""
    both = manifest.withColumn("at_", F.lit(0)).unionByName(seen.withColumn("at_", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, ["name"], "at_").drop("at_")
