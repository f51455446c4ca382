"""Geometry as columns: great circles, the conic projection, polygons with holes.

Polygons are arrays of polygons of rings of points (x, y); rings may or may not repeat their first point. All predicates
are higher-order functions in the JVM; only line simplification, which is recursive, goes through Arrow.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: GRS80, and the two-parallel conic of the metric system used here (EPSG:3161).
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
LAT0, LON0, LAT1, LAT2, EAST0, NORTH0 = 0.0, -85.0, 44.5, 53.5, 930000.0, 6430000.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def _conic() -> tuple[float, float, float, float]:
    """Eccentricity, cone constant, scale and the origin's radius of the conic."""
    e = math.sqrt(FLATTENING * (2 - FLATTENING))

    def m(lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)

    def t(lat: float) -> float:
        return math.tan(math.pi / 4 - lat / 2) / ((1 - e * math.sin(lat)) / (1 + e * math.sin(lat))) ** (e / 2)

    a, b, o = (math.radians(x) for x in (LAT1, LAT2, LAT0))
    n = (math.log(m(a)) - math.log(m(b))) / (math.log(t(a)) - math.log(t(b)))
    f = m(a) / (n * t(a) ** n)
    return e, n, f, AXIS * f * t(o) ** n


def project(lon: Column, lat: Column) -> Column:
    """Degrees to metres, as struct(x, y)."""
    e, n, f, r0 = _conic()
    s = F.sin(F.radians(lat))
    t = F.tan(F.lit(math.pi / 4) - F.radians(lat) / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))
    r, angle = AXIS * f * F.pow(t, F.lit(n)), n * F.radians(lon - LON0)
    return F.struct((EAST0 + r * F.sin(angle)).alias("x"), (NORTH0 + r0 - r * F.cos(angle)).alias("y"))


def unproject(x: Column, y: Column) -> Column:
    """Metres to degrees, as struct(lon, lat); five rounds settle the latitude far below a millimetre."""
    e, n, f, r0 = _conic()
    dx, dy = x - EAST0, r0 - (y - NORTH0)
    t = F.pow(F.sqrt(dx * dx + dy * dy) / (AXIS * f), F.lit(1 / n))
    lat = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(5):
        s = F.sin(lat)
        lat = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2)))
    return F.struct((LON0 + F.degrees(F.atan2(dx, dy)) / n).alias("lon"), F.degrees(lat).alias("lat"))


def _edges(ring: Column) -> Column:
    """A ring's edges, closed, as struct(a, b)."""
    return F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _all_edges(polygons: Column) -> Column:
    return F.flatten(F.transform(F.flatten(polygons), _edges))


def covers_by(edges: Column, odd: Column, x: Column, y: Column) -> Column:
    """Is the point inside, or on an edge? Inside: odd, changed by each edge between the point and the far right."""

    def crossed(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    def touched(s: Column) -> Column:
        a, b = s["a"], s["b"]
        flat = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return flat & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    crossings = F.size(F.filter(edges, lambda s: F.coalesce(crossed(s), F.lit(False))))
    return ((crossings + odd.cast("int")) % 2 == 1) | F.exists(edges, touched)


def covers(polygons: Column, x: Column, y: Column) -> Column:
    """Is the point in the polygons, or on an edge? Even-odd, so holes are out and their edges in."""
    return covers_by(_all_edges(polygons), F.lit(False), x, y)


def distance(polygons: Column, x: Column, y: Column) -> Column:
    """From the point to the polygons; 0 inside."""

    def squared(s: Column) -> Column:
        ax, ay, dx, dy = s["a"]["x"], s["a"]["y"], s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        length = dx * dx + dy * dy
        at = F.when(length == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - ax) * dx + (y - ay) * dy) / length)))
        px, py = ax + at * dx - x, ay + at * dy - y
        return px * px + py * py

    return F.when(covers(polygons, x, y), F.lit(0.0)).otherwise(F.sqrt(F.array_min(F.transform(_all_edges(polygons), squared))))


def area(polygons: Column) -> Column:
    """Shells less holes, whatever their direction. Polygons that may overlap are made one first: overlay.united()."""

    def ring(r: Column) -> Column:
        cross = F.transform(_edges(r), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
        return F.abs(F.aggregate(cross, F.lit(0.0), lambda t, v: t + v)) / 2

    def part(p: Column) -> Column:
        rings = F.transform(p, ring)
        return F.aggregate(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), F.coalesce(F.get(rings, F.lit(0)), F.lit(0.0)), lambda t, v: t - v)

    return F.aggregate(F.transform(polygons, part), F.lit(0.0), lambda t, v: t + v)


def bounds(polygons: Column) -> Column:
    points = F.flatten(F.flatten(polygons))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def tidy(polygons: Column, digits: int = 4) -> Column:
    """Coordinates rounded, equal points in a row made one, rings of fewer than four points dropped with polygons that lose their shell."""

    def points(r: Column) -> Column:
        rounded = F.transform(r, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))
        return F.filter(rounded, lambda p, i: (i == 0) | (p != F.get(rounded, i - 1)))

    rings = F.transform(polygons, lambda p: F.filter(F.transform(p, lambda r, i: F.struct(points(r).alias("ring"), i.alias("i"))), lambda s: F.size(s["ring"]) >= 4))
    whole = F.filter(rings, lambda p: (F.size(p) > 0) & (F.get(p, F.lit(0))["i"] == 0))
    return F.transform(whole, lambda p: F.transform(p, lambda s: s["ring"]))


def problems(polygons: Column) -> Column:
    """What keeps a geometry from being sound, as texts: for the log, which is where repairs are decided."""
    rings = F.flatten(polygons)
    return F.array_compact(
        F.array(
            F.when(polygons.isNull() | (F.size(rings) == 0), F.lit("empty")),
            F.when(F.exists(rings, lambda r: F.size(r) < 4), F.lit("ring of fewer than four points")),
            F.when(F.exists(rings, lambda r: F.get(r, F.lit(0)) != F.get(r, F.size(r) - 1)), F.lit("open ring")),
            F.when(F.exists(rings, lambda r: F.size(F.array_distinct(r)) < F.size(r) - 1), F.lit("ring touches itself")),
        )
    )


def _thinned(points: list, tolerance: float) -> list:
    """The points that a line keeps if none it loses is further from it than tolerance (Douglas and Peucker's rule)."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        i, j = todo.pop()
        (ax, ay), (bx, by) = points[i], points[j]
        dx, dy = bx - ax, by - ay
        length = math.hypot(dx, dy)
        far, at = tolerance, None
        for k in range(i + 1, j):
            px, py = points[k][0] - ax, points[k][1] - ay
            d = abs(px * dy - py * dx) / length if length else math.hypot(px, py)
            if d > far:
                far, at = d, k
        if at is not None:
            keep.add(at)
            todo += [(i, at), (at, j)]
    return [points[k] for k in sorted(keep)]


def simplify(polygons: Column, tolerance: float = 100.0) -> Column:
    """Rings with fewer points, none of the lost ones further than tolerance from the new line."""

    @F.pandas_udf("array<array<array<struct<x:double,y:double>>>>")
    def run(shapes: pd.Series) -> pd.Series:
        def ring(r):
            return [{"x": x, "y": y} for x, y in _thinned([(p["x"], p["y"]) for p in r], tolerance)] if len(r) > 3 else list(r)

        return shapes.map(lambda s: None if s is None else [[ring(r) for r in p] for p in s])

    return run(polygons)
