"""Spatial joins over a grid: point in polygon by quadtree cells, nearest within a radius, siblings, spans by hulls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import cover, geo
from ..functions.text import name_stem
from ..session import checkpointed


#: Places of a cell beyond which nearest points are first looked for in smaller ones.
CROWD = 64


def _cells(x0, y0, x1, y1, cell: float):
    """All grid cells of a box."""
    xs = F.sequence(F.floor(x0 / cell), F.floor(x1 / cell))
    ys = F.sequence(F.floor(y0 / cell), F.floor(y1 / cell))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def inside(points: DataFrame, polygons: DataFrame, cell: float, geometry: str = "geometry", x: str = "x", y: str = "y") -> DataFrame:
    """points ⋈ polygons that cover them, edges included, so a point on a shared edge is in both; without the geometry.

    Polygons are covered by cells of a quadtree, the smallest of them `cell` wide: large ones inside, small ones along
    the outline, so a wide polygon has as many rows as its outline is long. A point goes to its cell of each level that
    any polygon has; in a cell inside nothing is left to test, in the others a few edges are.
    """
    rest = [c for c in polygons.columns if c != geometry]
    covered = checkpointed(polygons.select(*[F.col(f"`{c}`") for c in rest], F.explode(cover.quadtree(F.col(geometry), cell)).alias("cover_")))
    levels = sorted(r[0] for r in covered.select("cover_.level").distinct().collect())  # a few, as each is twice as wide
    covered = covered.withColumn("cell_", F.struct("cover_.level", "cover_.cx", "cover_.cy"))

    def at(level: int) -> Column:
        size = F.lit(cell * 2.0**level)
        return F.struct(F.lit(level).alias("level"), F.floor(F.col(x) / size).alias("cx"), F.floor(F.col(y) / size).alias("cy"))

    own = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    own = own.withColumn("cell_", F.explode(F.array(*[at(n) for n in levels]))) if levels else own.where("false").withColumn("cell_", at(0))
    edges, odd = F.col("cover_.edges"), F.col("cover_.odd")
    in_ = F.when(F.size(edges) == 0, odd).otherwise(geo.covers_by(edges, odd, F.col(x), F.col(y)))
    return own.join(covered, "cell_").where(in_).drop("cell_", "cover_")


def nearest(polygons: DataFrame, points: DataFrame, key: str, name: str, radius: float, geometry: str = "geometry", x: str = "x", y: str = "y") -> DataFrame:
    """key, name, distance: of the points within radius of each polygon the nearest; of equals the first by name.

    Polygons go to all cells that their box and the radius reach, so a point needs its own cell only. The nearest is no
    further than what is nearest to one of a polygon's corners; points whose way to its box is longer aren't measured.
    """
    corner, finite = F.get(F.get(geometry, F.lit(0)), F.lit(0)), ~F.isnan("box_.x1") & ~F.isnan("box_.y1")
    box = polygons.select(key, geometry).withColumn("box_", geo.bounds(F.col(geometry))).withColumn("corner_", F.when(finite & (F.size(corner) > 1), F.get(corner, F.lit(0))))
    box = box.withColumn("cell_", F.explode(_cells(F.col("box_.x0") - radius, F.col("box_.y0") - radius, F.col("box_.x1") + radius, F.col("box_.y1") + radius, radius)))
    places = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.min(name).alias(name))
    own = places.withColumn("cell_", F.struct(F.floor(F.col(x) / radius).alias("cx"), F.floor(F.col(y) / radius).alias("cy")))
    px, py = F.col(x), F.col(y)
    reach = own.join(box.select(key, "cell_", "corner_"), "cell_").groupBy(key).agg(F.min(F.hypot(px - F.col("corner_.x"), py - F.col("corner_.y"))).alias("reach_"))
    box = box.drop("corner_").join(reach, key).withColumn("reach_", F.least(F.lit(radius), F.col("reach_")) * (1 + 1e-9) + 1e-6)
    aside = F.hypot(F.greatest(F.col("box_.x0") - px, px - F.col("box_.x1"), F.lit(0.0)), F.greatest(F.col("box_.y0") - py, py - F.col("box_.y1"), F.lit(0.0)))
    far = own.join(box, "cell_").where(aside <= F.col("reach_")).withColumn("distance", geo.distance(F.col(geometry), F.col(x), F.col(y))).where(F.col("distance") <= radius)
    best = far.groupBy(key).agg(F.min(F.struct("distance", name)).alias("best_"))
    return best.select(key, f"best_.{name}", "best_.distance")


def nearest_point(left: DataFrame, right: DataFrame, left_key: str, right_key: str, radius_km: float) -> DataFrame:
    """left_key, right_key, km: of right(lon, lat) the nearest within radius_km of each of left(lon, lat), by great circles.

    Cells are radius-high bands of latitude and, within them, columns as wide as the radius at the band's edge furthest
    from the equator; each left point looks into its cell and those around it. Columns meet at 180 degrees.

    Points of one place are one: on the right the first by key, on the left all get what their place does. Where places
    are many to a cell, smaller radii go first, and only places that find nothing there look further.
    """
    own = left.where("lon is not null and lat is not null").select(F.col(left_key), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    there = checkpointed(right.where("lon is not null and lat is not null").groupBy("lon", "lat").agg(F.min(right_key).alias(right_key)))
    band = F.floor(F.col("lat") / (radius_km / 111.0))
    cells = there.groupBy(band, F.floor(F.col("lon") * F.cos(F.radians((band + 0.5) * (radius_km / 111.0))) / (radius_km / 111.0))).count()
    crowd = cells.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] or 0  # places of a place's cell
    todo, found = own.select("lon1", "lat1").distinct(), []
    for i in range(max(0, math.ceil(math.log(max(crowd, 1) / CROWD, 16))), 0, -1):  # a quarter of the radius has a sixteenth of the places
        found.append(checkpointed(_within_radius(todo, there, right_key, radius_km / 4**i)))
        todo = checkpointed(todo.join(found[-1], ["lon1", "lat1"], "left_anti"))
    nearest_ = _within_radius(todo, there, right_key, radius_km)
    for one in found:
        nearest_ = nearest_.unionByName(one)
    best = own.join(nearest_, ["lon1", "lat1"]).groupBy(left_key).agg(F.min("best_").alias("best_"))
    return best.select(left_key, f"best_.{right_key}", "best_.km")


def _within_radius(left: DataFrame, right: DataFrame, right_key: str, radius_km: float) -> DataFrame:
    """lon1, lat1, best_(km, right_key): the nearest of right(lon, lat) within the radius of each of left(lon1, lat1), through cells (see nearest_point)."""
    high = radius_km / (geo.EARTH_KM * 3.141592653589793 / 180) * 1.000001
    band = F.floor(F.col("lat") / high)

    def columns(b):
        edge = F.least(F.lit(90.0), F.greatest(F.abs(b * high), F.abs((b + 1) * high)))
        # Across the radius longitudes differ by asin(sin(r) / cos(lat)) at most; near a pole by anything.
        reach = F.sin(F.radians(F.lit(high))) / F.cos(F.radians(edge))
        wide = F.when((edge >= 90) | (reach >= 1), 360.0).otherwise(F.degrees(F.asin(reach)))
        return F.greatest(F.lit(1), F.floor(F.lit(360.0) / wide)).cast("long")

    def column(lon, b):
        return F.least(columns(b) - 1, F.floor((lon + 180.0) / 360.0 * columns(b)))

    own = left.select("lon1", "lat1", F.floor(F.col("lat1") / high).alias("b0"))
    own = own.withColumn("b_", F.explode(F.array(F.col("b0") - 1, F.col("b0"), F.col("b0") + 1)))
    own = own.withColumn("c_", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(column(F.col("lon1"), F.col("b_")) + d, columns(F.col("b_")))))))
    other = right.select(F.col(right_key), "lon", "lat", band.alias("b_")).withColumn("c_", column(F.col("lon"), F.col("b_")))
    near = own.join(other, ["b_", "c_"]).withColumn("km", geo.haversine_km(F.col("lon1"), F.col("lat1"), F.col("lon"), F.col("lat"))).where(F.col("km") <= radius_km)
    return near.groupBy("lon1", "lat1").agg(F.min(F.struct("km", right_key)).alias("best_"))


def _cube(names: tuple[str, str, str], side: Column) -> Column:
    return F.struct(*[F.floor(F.col(c) / side).alias(f"i{k}") for k, c in enumerate(names)])


def _around(cube: Column) -> Column:
    """The 27 cubes at and around one."""
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    return F.array(*[F.struct(*[(cube[f"i{k}"] + d).alias(f"i{k}") for k, d in enumerate(step)]) for step in steps])


def nearest_sibling(own: DataFrame, of: DataFrame, km: float) -> DataFrame:
    """name_, km: of each place of `of`, which are among own(name_, stem_, lon_, lat_, u, v, w), the distance to the nearest other name of its stem; none has no row.

    Cubes of the sphere's space are twice as wide from level to level, and counted at each. A place finds the first level
    at which the cubes around its own hold another name; the nearest one is then within the cubes around it two levels
    up, where distances are measured. km sets the smallest cubes.
    """
    side = 2 * math.sin(km / geo.EARTH_KM / 2)
    levels = max(1, math.ceil(math.log2(4 / side)) + 1)
    width = F.lit(side) * F.pow(F.lit(2.0), F.col("level_"))
    every = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level_")
    axes = ("u", "v", "w")
    stems = of.select("stem_").distinct()
    held = own.join(stems, "stem_", "left_semi").select("name_", "stem_", *axes, every).withColumn("cube_", _cube(axes, width))
    counts = held.groupBy("stem_", "level_", "cube_").agg(F.min("name_").alias("first_"), F.max("name_").alias("last_"))
    ask = of.select("name_", "stem_", *axes, "lon_", "lat_", every).withColumn("cube_", F.explode(_around(_cube(axes, width))))
    first = ask.join(counts, ["stem_", "level_", "cube_"]).where((F.col("first_") != F.col("name_")) | (F.col("last_") != F.col("name_"))).groupBy("name_", "stem_", *axes, "lon_", "lat_").agg(F.min("level_").alias("found_"))
    # Within the cubes around are 2 * sqrt(3) sides at most; two levels up a side is four.
    near = first.withColumn("level_", F.least(F.col("found_") + 2, F.lit(levels))).withColumn("cube_", F.explode(_around(_cube(axes, width))))
    there = own.join(stems, "stem_", "left_semi").select(F.col("name_").alias("other_"), "stem_", F.col("lon_").alias("lon2_"), F.col("lat_").alias("lat2_"), *axes, every).withColumn("cube_", _cube(axes, width)).drop(*axes)
    pairs = near.join(there, ["stem_", "level_", "cube_"]).where("name_ <> other_")
    return pairs.groupBy("name_").agg(F.min(geo.haversine_km(F.col("lon_"), F.col("lat_"), F.col("lon2_"), F.col("lat2_"))).alias("km"))


def quarantine(nodes: DataFrame, explicit: tuple[str, ...] = (), km: float = 25.0, name: str = "Location", lon: str = "Longitude", lat: str = "Latitude") -> DataFrame:
    """name, km (to the nearest sibling, if any): nodes further than km from every node of their stem, and the explicit ones.

    Nodes that share a cube so small that all in it are within km of each other are near without a look at pairs. A node
    alone in its cube is held against the cubes around; only those that have nothing within km there look further.
    """
    place = F.radians(F.col("lat_")), F.radians(F.col("lon_"))
    own = nodes.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.col(name).alias("name_"), F.col(lon).alias("lon_"), F.col(lat).alias("lat_"), name_stem(F.col(name)).alias("stem_"))
    own = own.withColumn("u", F.cos(place[0]) * F.cos(place[1])).withColumn("v", F.cos(place[0]) * F.sin(place[1])).withColumn("w", F.sin(place[0]))
    axes, chord = ("u", "v", "w"), 2 * math.sin(km / geo.EARTH_KM / 2)
    small = own.withColumn("cube_", _cube(axes, F.lit(chord / math.sqrt(3) * 0.999999)))
    crowded = small.groupBy("stem_", "cube_").agg((F.min("name_") != F.max("name_")).alias("crowded_"))
    alone = small.join(crowded, ["stem_", "cube_"]).where("not crowded_").drop("cube_", "crowded_")
    wide = F.lit(chord * 1.000001)
    ask = alone.withColumn("cube_", F.explode(_around(_cube(axes, wide))))
    there = own.select(F.col("name_").alias("other_"), "stem_", F.col("lon_").alias("lon2_"), F.col("lat_").alias("lat2_"), _cube(axes, wide).alias("cube_"))
    within = ask.join(there, ["stem_", "cube_"]).where((F.col("name_") != F.col("other_")) & (geo.haversine_km(F.col("lon_"), F.col("lat_"), F.col("lon2_"), F.col("lat2_")) <= km))
    # A name in several places is near if one of them is.
    near = within.select("name_").unionByName(small.join(crowded, ["stem_", "cube_"]).where("crowded_").select("name_")).distinct()
    listed = F.col("name_").isin(*explicit) if explicit else F.lit(False)
    far = own.join(near.withColumn("near_", F.lit(True)), "name_", "left").where(F.col("near_").isNull() | listed).drop("near_")
    gap = nearest_sibling(own, far, km)
    out = nodes.select(F.col(name).alias("name_")).distinct().join(gap, "name_", "left").where((F.col("km") > km) | listed)
    return out.select(F.col("name_").alias(name), "km")


def _hulls(key: str, x: str, y: str, most: int):
    """A function of batches: the corners of the hulls of keys' points, of `most` points together at a time."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        points, kind = 0, None

        def out() -> pa.RecordBatch:
            corners = {k: cover.hull(np.concatenate(v)) for k, v in held.items()}
            xy = np.concatenate(list(corners.values()))
            return pa.RecordBatch.from_arrays([pa.array([k for k, c in corners.items() for _ in range(len(c))], kind), pa.array(xy[:, 0]), pa.array(xy[:, 1])], [key, x, y])

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).type
            codes = batch.column(0).dictionary_encode()
            own, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            xy = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)])
            order = np.argsort(own, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                held.setdefault(names[own[part[0]]], []).append(xy[part])
            points += batch.num_rows
            if points >= most:
                yield out()
                held, points = {}, 0
        if held:
            yield out()

    return of


def span_km(inside_: DataFrame, key: str, x: str = "x", y: str = "y", most: int = 500_000) -> DataFrame:
    """key, span_km: the greatest distance between two of a key's points (metres in); 0 for one.

    The two are corners of the key's convex hull. Each task first makes hulls of what it has of a key, so that only
    corners are shuffled; the hull of those is walked with turning calipers. Nulls don't count.
    """
    own = inside_.select(key, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).where(F.col(key).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    corners = own.mapInArrow(_hulls(key, x, y, most), own.schema)

    def widest(table: pa.Table) -> pa.Table:
        xy = np.column_stack([table.column(c).to_numpy() for c in (x, y)])
        return pa.table({key: table.column(key).combine_chunks().slice(0, 1), "span_km": pa.array([cover.widest(cover.hull(xy)) / 1000])})

    return corners.groupBy(key).applyInArrow(widest, StructType([own.schema[0], StructField("span_km", DoubleType())]))
