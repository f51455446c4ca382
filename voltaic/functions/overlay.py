"""Repair and union of polygons as columns: geometries are laid on a fine grid, noded, and traced anew (see planar).

Both run on Arrow batches in Python, a geometry at a time, as no built-in function can node segments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import planar

SHAPE = "array<array<array<struct<x:double,y:double>>>>"
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW_SHAPE = pa.list_(pa.list_(pa.list_(POINT)))
#: The grid's step in units of the coordinates, a power of two so that scaling is exact: 4 mm if they are metres.
GRID = 2.0**-8
#: Points of geometries that are noded together.
POINTS = 50_000


def rings(shapes: pa.Array) -> list[list[list[np.ndarray]] | None]:
    """Each geometry's polygons' rings as rows of x and y; None for null."""

    def within(a: pa.Array) -> pa.Array:
        return a.flatten() if len(a) else pa.array([], a.type.value_type)  # an empty one may come without offsets

    polys = within(shapes)
    flat = within(polys)
    points = within(flat)
    xy = np.column_stack([np.asarray(points.field(c).to_numpy(zero_copy_only=False), np.float64) for c in ("x", "y")]) if len(points) else np.empty((0, 2))

    def ends(a) -> list[int]:
        if not len(a):
            return [0]
        return np.concatenate(([0], np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(int).tolist()

    of_ring, of_polygon, of_shape = ends(flat), ends(polys), ends(shapes)
    parts = [xy[a:b] for a, b in zip(of_ring, of_ring[1:])]
    polygons = [parts[a:b] for a, b in zip(of_polygon, of_polygon[1:])]
    return [None if null else polygons[a:b] for null, a, b in zip(shapes.is_null().to_pylist(), of_shape, of_shape[1:])]


class Grid:
    """Whole numbers for coordinates: the given step, or a coarser power of two for what reaches too far from its centre."""

    def __init__(self, xy: np.ndarray, step: float):
        low, high = xy.min(axis=0), xy.max(axis=0)
        while (high - low).max() / step > planar.REACH:
            step *= 2
        self.step, self.centre = step, np.rint((low + high) / 2 / step) * step

    def to(self, xy: np.ndarray) -> np.ndarray:
        return np.rint((xy - self.centre) / self.step).astype(np.int64)

    def back(self, ring: list[tuple[int, int]]) -> list[dict]:
        xy = np.array([*ring, ring[0]], np.int64) * self.step + self.centre
        return [{"x": x, "y": y} for x, y in xy.tolist()]


def merged_each(shapes: list[list[list[np.ndarray]]], step: float = GRID, points: int = POINTS) -> list[tuple[list, Grid | None]]:
    """merged() of each shape's parts: shapes lie side by side on the grid, so that all of about so many points are noded and traced together."""
    out: list[tuple[list, Grid | None]] = [([], None) for _ in shapes]
    held: list[tuple[int, Grid, int, int]] = []  # shape, its grid, how far it is moved, where it begins
    own: list[np.ndarray] = []
    tags: list[tuple[list[int], list[int]]] = []  # the part of each ring, and its size
    size = n_tags = 0
    at = -planar.REACH

    def settle() -> None:
        pieces = planar.boundary(np.concatenate(own), np.repeat(np.concatenate([t for t, _ in tags]), np.concatenate([n for _, n in tags])))
        of = np.searchsorted([h[3] for h in held], np.minimum(pieces[:, 0], pieces[:, 2]), "right") - 1
        order = np.argsort(of, kind="stable")
        of, pieces = of[order], pieces[order]
        pieces[:, [0, 2]] -= np.array([h[2] for h in held])[of][:, None]
        cut = np.searchsorted(of, np.arange(len(held) + 1)).tolist()
        for (i, grid, _, _), a, b in zip(held, cut, cut[1:]):
            out[i] = planar.polygons(pieces[a:b]), grid

    for i, parts in enumerate(shapes):
        good = [(k, r) for k, part in enumerate(parts) for r in part if len(r) > 2 and np.isfinite(r).all()]
        if not good:
            continue
        xy, sizes = np.concatenate([r for _, r in good]), [len(r) for _, r in good]
        grid = Grid(xy, step)
        s = planar.segments(grid.to(xy), sizes)
        low, high = int(s[:, 0].min()), int(s[:, 0].max())
        if held and (size + len(s) > points or at + high - low + 2 > planar.REACH):
            settle()
            held, own, tags, size, n_tags, at = [], [], [], 0, 0, -planar.REACH
        moved = at - low + (at - low) % 2  # even, so that halves are rounded alike wherever a shape lies
        held.append((i, grid, moved, low + moved))
        s[:, [0, 2]] += moved
        own.append(s)
        tags.append(([n_tags + k for k, _ in good], sizes))
        size, n_tags, at = size + len(s), n_tags + len(parts), high + moved + 2
    if held:
        settle()
    return out


def merged(parts: list[list[np.ndarray]], step: float = GRID) -> tuple[list, Grid | None]:
    """Sound polygons, on the grid, of the union of parts; a part is what an odd number of its rings encloses.

    Rings with points that aren't finite or of fewer than three points enclose nothing.
    """
    return merged_each([parts], step)[0]


def _outline(polygons: list[list[list[tuple[int, int]]]]) -> set:
    """What doesn't depend on where rings start or which way they turn: each shell's edges with those of its holes."""

    def edges(ring) -> frozenset:
        return frozenset(frozenset(e) for e in zip(ring, ring[1:] + ring[:1]))

    return {(edges(p[0]), frozenset(edges(r) for r in p[1:])) for p in polygons}


def is_sound(shape: list[list[np.ndarray]], polygons: list, grid: Grid | None) -> bool:
    """Are the polygons, rebuilt from the geometry by noding, the geometry itself, but for points within straight lines and repeated ones?"""
    if grid is None or not all(p and all(len(r) > 3 and (r[0] == r[-1]).all() for r in p) for p in shape):
        return False
    own = []
    for p in shape:
        own.append([])
        for r in p:
            if not np.isfinite(r).all():
                return False
            points = [tuple(q) for q in grid.to(r[:-1]).tolist()]
            points = [q for q, before in zip(points, points[-1:] + points[:-1]) if q != before]
            if len(set(points)) < len(points) or len(points) < 3:
                return False
            own[-1].append(planar.straightened(points))
    return _outline(own) == _outline(polygons) and sum(map(len, own)) == sum(map(len, polygons))


def plain(polygons: list, grid: Grid | None) -> list:
    """Polygons on the grid as lists of rings of points, each ring closed."""
    return [[grid.back(r) for r in p] for p in polygons]  # type: ignore[union-attr]


def repaired(polygons: Column, grid: float = GRID) -> Column:
    """struct(geometry, repaired): the geometry as sound polygons of what an odd number of its rings encloses.

    A bow-tie gives its two halves, a spike goes, of overlapping shells the common part is out, nested shells take
    turns. A sound geometry stays as it is, point by point, with repaired false. Null stays null; an empty geometry, and
    one that encloses nothing, give an empty one.
    """

    @F.arrow_udf(f"struct<geometry:{SHAPE},repaired:boolean>")
    def run(shapes: pa.Array) -> pa.Array:
        found, changed = [], []
        own = rings(shapes)
        for shape, given, (new, at) in zip(own, shapes, merged_each([[[r for p in shape or [] for r in p]] for shape in own], grid)):
            if shape is None:
                found.append(None)
                changed.append(None)
                continue
            sound = not shape or is_sound(shape, new, at)
            found.append(given.as_py() if sound else plain(new, at))
            changed.append(not sound)
        return pa.StructArray.from_arrays([pa.array(found, ARROW_SHAPE), pa.array(changed, pa.bool_())], ["geometry", "repaired"], mask=pa.array([f is None for f in found]))

    return run(polygons)


def united(polygons: Column, grid: float = GRID) -> Column:
    """The geometry with its polygons merged where they overlap or share an edge, as sound polygons; each polygon is what an odd number of its own rings encloses."""

    @F.arrow_udf(SHAPE)
    def run(shapes: pa.Array) -> pa.Array:
        own = rings(shapes)
        return pa.array([None if shape is None else plain(*new) for shape, new in zip(own, merged_each([shape or [] for shape in own], grid))], ARROW_SHAPE)

    return run(polygons)
