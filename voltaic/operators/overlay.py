"""Dissolving polygons by key, overlaps counted once, however many parts a key has."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, overlay
from ..session import checkpointed, small_batches

#: Points of parts that are merged at once, and rows of a key that one task may merge in the end.
POINTS, FEW = 50_000, 32


def _spread(n: Column) -> Column:
    """The 16 low bits of n with a bit's room between each two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return n


def z_order(box: Column, world: Column) -> Column:
    """A number that is near for boxes that are near: the bits of both coordinates of its middle, in turn."""

    def place(low: str, high: str) -> Column:
        wide = world[high] - world[low]
        middle = (box[low] + box[high]) / 2 - world[low]
        return F.when(wide > 0, F.floor(middle / wide * 65535)).otherwise(F.lit(0)).cast("long")

    return _spread(place("x0", "x1")).bitwiseOR(F.shiftleft(_spread(place("y0", "y1")), 1))


def _merging(points: int, grid: float, least: int):
    """A function of batches in order of key: runs of equal keys become one row each, or several of `points` points or more (of `least` rows at least)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, z, parts, rows, held = None, 0, [], 0, 0

        def out() -> pa.RecordBatch:
            shape = overlay.plain(*overlay.merged(parts, grid))
            return pa.RecordBatch.from_arrays([key, pa.array([z], pa.int64()), pa.array([shape], overlay.ARROW_SHAPE)], ["key_", "z_", "geometry_"])

        for batch in batches:
            for i, shape in enumerate(overlay.rings(batch.column("geometry_"))):
                own = batch.column("key_").slice(i, 1)
                if rows and (not own.equals(key) or (held >= points and rows >= least)):
                    yield out()
                    parts, rows, held = [], 0, 0
                if not rows:
                    key, z = own, batch.column("z_")[i].as_py()
                parts += shape or []
                rows += 1
                held += sum(len(r) for p in shape or [] for r in p)
        if rows:
            yield out()

    return of


def dissolve(parts: DataFrame, key: str, geometry: str = "geometry", grid: float = overlay.GRID, points: int = POINTS) -> DataFrame:
    """key, geometry: the union of all polygons of a key's rows, as sound polygons on the grid.

    Parts that are near each other merge first: rows lie by range of key and place, each task merges what follows each
    other up to `points` points, and again, until a key has few rows, which one task merges. So a key of any number of
    parts is spread over tasks, and only boundaries that are left move on. Null geometries add nothing, a null key is a
    key, an empty table gives an empty result.
    """
    spark = parts.sparkSession
    own = parts.select(F.col(f"`{key}`").alias("key_"), F.col(f"`{geometry}`").cast(overlay.SHAPE).alias("geometry_"))
    box = own.select("*", geo.bounds(F.col("geometry_")).alias("box_"))
    world = box.agg(F.min("box_.x0").alias("x0"), F.min("box_.y0").alias("y0"), F.max("box_.x1").alias("x1"), F.max("box_.y1").alias("y1"))
    own = box.crossJoin(F.broadcast(world.select(F.struct("*").alias("world_"))))  # one row
    own = own.select("key_", F.coalesce(z_order(F.col("box_"), F.col("world_")), F.lit(0)).alias("z_"), "geometry_")
    schema = own.schema
    with small_batches(spark):
        while (most := own.groupBy("key_").count().agg(F.max("count")).first()[0] or 0) > FEW:
            before = most
            ranged = own.repartitionByRange("key_", "z_").sortWithinPartitions("key_", "z_")
            own = checkpointed(ranged.mapInArrow(_merging(points, grid, 2), schema))
            if (own.groupBy("key_").count().agg(F.max("count")).first()[0] or 0) >= before:
                break  # as many ranges as rows are left
        out = checkpointed(own.repartition("key_").sortWithinPartitions("key_", "z_").mapInArrow(_merging(2**62, grid, 2), schema))
    return out.select(F.col("key_").alias(key), F.col("geometry_").alias(geometry))
