"""Covers of polygons by quadtree cells, hulls of points and their widest span: the numeric parts of the spatial joins."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .overlay import SHAPE, rings

CELLS = "array<struct<level:int,cx:long,cy:long,odd:boolean,edges:array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>>>"
#: Edges that a cell may hold before it is split.
EDGES = 16


def _meets(e: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Which edges (x1, y1, x2, y2) meet the box."""
    near = (np.minimum(e[:, 0], e[:, 2]) <= x1) & (np.maximum(e[:, 0], e[:, 2]) >= x0) & (np.minimum(e[:, 1], e[:, 3]) <= y1) & (np.maximum(e[:, 1], e[:, 3]) >= y0)
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    corners = np.stack([dx * (y - e[:, 1]) - dy * (x - e[:, 0]) for x in (x0, x1) for y in (y0, y1)])
    return near & ~((corners > 0).all(axis=0) | (corners < 0).all(axis=0))


def cells(edges: np.ndarray, cell: float, most: int = EDGES) -> list[tuple[int, int, int, bool, np.ndarray]]:
    """level, cx, cy, odd, edges of the quadtree cells that a shape's edges enclose or meet; a cell of level n is cell * 2**n wide.

    Cells are split until they hold `most` edges (and not many more beside them) or are of level 0, so there are as many as the outline is long, not as
    the shape is wide. A cell that no edge meets is wholly inside (odd, and without edges) or left out. The others have
    the edges that decide whether a point in them is inside: those that meet it, and those right of it that end at its
    height; odd tells of the edges right of it at all of its height.
    """
    if not len(edges):
        return []
    x0, y0 = edges[:, [0, 2]].min(), edges[:, [1, 3]].min()
    x1, y1 = edges[:, [0, 2]].max(), edges[:, [1, 3]].max()
    level = max(0, math.ceil(math.log2(max(x1 - x0, y1 - y0, cell) / cell)))
    size = cell * 2.0**level
    todo = [(level, i, j, edges, False) for i in range(math.floor(x0 / size), math.floor(x1 / size) + 1) for j in range(math.floor(y0 / size), math.floor(y1 / size) + 1)]
    out = []
    while todo:
        level, i, j, own, odd = todo.pop()
        size = cell * 2.0**level
        x0, y0, x1, y1 = i * size, j * size, (i + 1) * size, (j + 1) * size
        slack = 1e-9 * max(size, abs(x1), abs(y1)) if max(abs(x1), abs(y1)) < 1e6 * size else 1e-15 * max(abs(x1), abs(y1))
        meets = _meets(own, x0 - slack, y0 - slack, x1 + slack, y1 + slack)
        rest = own[~meets]
        low, high = np.minimum(rest[:, 1], rest[:, 3]), np.maximum(rest[:, 1], rest[:, 3])
        rest, low, high = (x[(low <= y1 + slack) & (high > y0 - slack)] for x in (rest, low, high))
        # Such an edge is on one side of the cell at all heights that both have.
        y = (np.maximum(low, y0) + np.minimum(high, y1)) / 2
        rise = rest[:, 3] - rest[:, 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            right = (rise != 0) & (rest[:, 0] + (rest[:, 2] - rest[:, 0]) * (y - rest[:, 1]) / rise > (x0 + x1) / 2)
        whole = right & (low <= y0 - slack) & (high > y1 + slack)
        odd ^= bool(whole.sum() % 2)
        ends, own = rest[right & ~whole], own[meets]
        if not len(own):
            y = (y0 + y1) / 2
            if odd ^ bool((((ends[:, 1] > y) != (ends[:, 3] > y)).sum()) % 2):
                out.append((level, i, j, True, ends[:0]))
        elif level == 0 or (len(own) <= most and len(ends) <= 8 * most):
            out.append((level, i, j, odd, np.concatenate((own, ends))))
        else:
            both = np.concatenate((own, ends))
            todo += [(level - 1, 2 * i + a, 2 * j + b, both, odd) for a in (0, 1) for b in (0, 1)]
    return out


def quadtree(polygons: Column, cell: float) -> Column:
    """The cells of a geometry, as rows of CELLS; null and empty geometries have none."""

    @F.arrow_udf(CELLS)
    def run(shapes: pa.Array) -> pa.Array:
        found = []
        for shape in rings(shapes):
            parts = [np.hstack((r, np.roll(r, -1, axis=0))) for p in shape or [] for r in p if len(r)]
            own = cells(np.concatenate(parts), cell) if parts else []
            found.append([{"level": n, "cx": i, "cy": j, "odd": odd, "edges": [{"a": {"x": a, "y": b}, "b": {"x": c, "y": d}} for a, b, c, d in e.tolist()]} for n, i, j, odd, e in own])
        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        edge = pa.struct([("a", point), ("b", point)])
        return pa.array(found, pa.list_(pa.struct([("level", pa.int32()), ("cx", pa.int64()), ("cy", pa.int64()), ("odd", pa.bool_()), ("edges", pa.list_(edge))])))

    return run(polygons.cast(SHAPE))


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points (x, y), turning left; each once."""
    points = np.unique(points, axis=0)
    if len(points) > 64:
        # What lies well within the outermost points of sixteen directions is no corner.
        angles = np.arange(16) * np.pi / 8
        outer = np.unique(np.argmax(points @ np.stack((np.cos(angles), np.sin(angles))), axis=0))
        ring = points[outer]
        middle = ring.mean(axis=0)
        ring = ring[np.argsort(np.arctan2(*(ring - middle).T[::-1]))]
        nxt = np.roll(ring, -1, axis=0)
        inside = np.ones(len(points), bool)
        for (ax, ay), (bx, by) in zip(ring, nxt):
            inside &= (bx - ax) * (points[:, 1] - ay) - (by - ay) * (points[:, 0] - ax) > 1e-9 * (abs(bx - ax) + abs(by - ay))
        points = points[~inside]
    if len(points) < 3:
        return points

    def half(rows: list[list[float]]) -> list[list[float]]:
        out: list[list[float]] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    rows = points.tolist()
    lower, upper = half(rows), half(rows[::-1])
    return np.array(lower[:-1] + upper[:-1])


def widest(corners: np.ndarray) -> float:
    """The greatest distance between two corners of a hull that turns left, by calipers that turn with its edges."""
    h = corners.tolist()
    n = len(h)
    if n < 2:
        return 0.0
    if n == 2:
        return math.dist(*h)

    def beyond(i: int, j: int) -> float:
        (ax, ay), (bx, by), (cx, cy) = h[i], h[(i + 1) % n], h[j % n]
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    best, j = 0.0, 1
    for i in range(n):
        while beyond(i, j + 1) > beyond(i, j):
            j += 1
        for a in (i, i + 1):
            for b in (j, j + 1):
                best = max(best, math.dist(h[a % n], h[b % n]))
    return best
