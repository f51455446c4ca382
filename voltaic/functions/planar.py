"""Planar overlays on an integer grid: noding, regions of rings, and their boundaries as sound polygons.

Coordinates are whole numbers of 2**28 at most in size, so every test of sides is exact in 64 bits. Segments are rows
x1, y1, x2, y2. An overlay goes in three steps: segments are split wherever they meet; of each piece it is settled
whether the region lies on either side; pieces with the region on one side only are its boundary, and are walked into rings.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

#: Pairs of segments that are looked at together.
PAIRS = 2_000_000
#: The largest coordinate; sides of points in half units then fit in 64 bits.
REACH = 1 << 28


def _places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths laid end to end: each element's run, and its place in it."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - (np.cumsum(counts) - counts)[run]


def _banded(low: np.ndarray, high: np.ndarray, n: int):
    """The width of bands that n ranges fill about evenly, and each range's first and last band; bands are as wide as ranges on average, so these have few each."""
    wide = max(1, int((high.max() - low.min()) // max(1, n)), int((high - low).mean())) if n else 1
    return wide, low // wide, high // wide


def _side(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positive where the point is left of its segment, negative right, 0 on its line."""
    return (s[:, 2] - s[:, 0]) * (y - s[:, 1]) - (s[:, 3] - s[:, 1]) * (x - s[:, 0])


def _meeting(s: np.ndarray):
    """Pairs i, j of segments whose boxes meet, in portions, each pair once."""
    x0, x1 = np.minimum(s[:, 0], s[:, 2]), np.maximum(s[:, 0], s[:, 2])
    y0, y1 = np.minimum(s[:, 1], s[:, 3]), np.maximum(s[:, 1], s[:, 3])
    _, first, last = _banded(y0, y1, len(s))
    run, nth = _places(last - first + 1)
    band = first[run] + nth
    order = np.lexsort((x0[run], band))
    own, band = run[order], band[order]
    # Partners come after, in the same band, and start before this one ends.
    key = (band - band.min()) * (4 * REACH + 1)
    until = np.searchsorted(key + x0[own] + 2 * REACH, key + x1[own] + 2 * REACH, "right")
    many = until - np.arange(len(own)) - 1
    done = np.cumsum(many)
    i = 0
    while i < len(own):
        k = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + PAIRS, "right")))
        run, nth = _places(many[i:k])
        a, at = own[i:k][run], i + run + 1 + nth
        b = own[at]
        keep = (y0[a] <= y1[b]) & (y0[b] <= y1[a]) & (band[at] == np.maximum(first[a], first[b]))
        yield a[keep], b[keep]
        i = k


def noded(s: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments and their tags, split until any two share end points at most, or are equal.

    Crossings are rounded to the grid, which may bend a segment into another, so splitting goes on until none is left.
    """
    while True:
        keep = (s[:, 0] != s[:, 2]) | (s[:, 1] != s[:, 3])
        s, tag = s[keep], tag[keep]
        cut, xs, ys = [], [], []
        if not len(s):
            return s, tag
        for a, b in _meeting(s):
            p, q = s[a], s[b]
            sides = [_side(q, p[:, 0], p[:, 1]), _side(q, p[:, 2], p[:, 3]), _side(p, q[:, 0], q[:, 1]), _side(p, q[:, 2], q[:, 3])]
            # An end of one on the other.
            for end, line, of, x, y in ((sides[0], q, b, p[:, 0], p[:, 1]), (sides[1], q, b, p[:, 2], p[:, 3]), (sides[2], p, a, q[:, 0], q[:, 1]), (sides[3], p, a, q[:, 2], q[:, 3])):
                on = np.flatnonzero(end == 0)
                l, u, v = line[on], x[on], y[on]
                inside = (np.minimum(l[:, 0], l[:, 2]) <= u) & (u <= np.maximum(l[:, 0], l[:, 2])) & (np.minimum(l[:, 1], l[:, 3]) <= v) & (v <= np.maximum(l[:, 1], l[:, 3]))
                inside &= ((u != l[:, 0]) | (v != l[:, 1])) & ((u != l[:, 2]) | (v != l[:, 3]))
                cut.append(of[on][inside])
                xs.append(u[inside])
                ys.append(v[inside])
            # A crossing within both.
            at = np.flatnonzero((np.sign(sides[0]) * np.sign(sides[1]) < 0) & (np.sign(sides[2]) * np.sign(sides[3]) < 0))
            if len(at):
                p, one, two = p[at], sides[0][at].astype(float), sides[1][at].astype(float)
                t = one / (one - two)
                u, v = (np.rint(p[:, k] + t * (p[:, k + 2] - p[:, k])).astype(np.int64) for k in (0, 1))
                for of in (a[at], b[at]):
                    l = s[of]
                    inside = ((u != l[:, 0]) | (v != l[:, 1])) & ((u != l[:, 2]) | (v != l[:, 3]))
                    cut.append(of[inside])
                    xs.append(u[inside])
                    ys.append(v[inside])
        if not sum(map(len, cut)):
            return s, tag
        whole = np.arange(len(s))
        of = np.concatenate((whole, *cut, whole))
        x, y = np.concatenate((s[:, 0], *xs, s[:, 2])), np.concatenate((s[:, 1], *ys, s[:, 3]))
        along = np.abs(x - s[of, 0]) + np.abs(y - s[of, 1])
        along[-len(s) :] = 4 * REACH + 1
        order = np.lexsort((along, of))
        of, x, y = of[order], x[order], y[order]
        same = of[1:] == of[:-1]
        s, tag = np.stack((x[:-1], y[:-1], x[1:], y[1:]), axis=1)[same], tag[of[:-1]][same]


class _Rising:
    """Segments that rise, each from its lower end, by bands of height and place from left to right."""

    def __init__(self, s: np.ndarray, tag: np.ndarray):
        rises = s[:, 1] != s[:, 3]
        up, self.tag = s[rises], tag[rises]
        self.up = np.where((up[:, 1] > up[:, 3])[:, None], up[:, [2, 3, 0, 1]], up)
        if not len(up):
            return
        self.wide, first, last = _banded(self.up[:, 1], self.up[:, 3], len(up))
        run, nth = _places(last - first + 1)
        band = first[run] + nth
        x0 = np.minimum(self.up[:, 0], self.up[:, 2])
        order = np.lexsort((x0[run], band))
        self.own, band = run[order], band[order]
        self.base, self.top = int(band.min()) - 1, int(band.max()) + 1
        self.key = (band - self.base) * (8 * REACH + 1) + x0[self.own] + 4 * REACH

    def range(self, mx: np.ndarray, my: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the segments of each point's band that may be left of it lie, and how many they are."""
        if not len(self.up):
            return np.zeros(len(mx), np.int64), np.zeros(len(mx), np.int64)
        at = np.clip(my // self.wide, self.base, self.top) - self.base
        lo, hi = np.searchsorted(self.key, at * (8 * REACH + 1), "left"), np.searchsorted(self.key, at * (8 * REACH + 1) + mx + 4 * REACH, "right")
        return lo, np.maximum(hi - lo, 0)

    def crossed(self, mx: np.ndarray, my: np.ndarray, lo: np.ndarray, many: np.ndarray, before: bool, tags: int):
        """query * tags + tag of an odd number of segments of the tag between the point and the far left, in portions.

        before: seen from just below the point instead, where a segment through it that goes right is left of it.
        """
        done = np.cumsum(many)
        i = 0
        while i < len(mx):
            k = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + PAIRS, "right")))
            run, nth = _places(many[i:k])
            query, f = i + run, self.own[lo[i:k][run] + nth]
            e, y = self.up[f], my[query]
            side = _side(e, mx[query], y)
            if before:
                left = (e[:, 1] < y) & (y <= e[:, 3]) & ((side < 0) | ((side == 0) & (e[:, 2] > e[:, 0])))
            else:
                left = (e[:, 1] <= y) & (y < e[:, 3]) & (side < 0)
            pair, times = np.unique(query[left] * tags + self.tag[f[left]], return_counts=True)
            yield pair[times % 2 == 1]
            i = k


def _crossed(mx: np.ndarray, my: np.ndarray, across: _Rising, along: _Rising, tags: int) -> tuple[np.ndarray, np.ndarray]:
    """query, tag of the tags whose region holds the place just left of the point (mx, my), the middle of a piece that rises.

    Each point is seen along the line to the left, or along the one down from just left of it, whichever has fewer
    segments to look at, so neither a row nor a column of many parts is looked at pair by pair. along: the segments with
    x and y swapped.
    """
    lo, many = across.range(mx, my)
    lo2, many2 = along.range(my, mx)
    found = []
    for way, x, y, at, n, use in ((across, mx, my, lo, many, many <= many2), (along, my, mx, lo2, many2, many > many2)):
        which = np.flatnonzero(use)
        for pair in way.crossed(x[which], y[which], at[which], n[which], way is along, tags) if len(which) else ():
            found.append(which[pair // tags] * tags + pair % tags)
    pair = np.concatenate(found) if found else np.empty(0, np.int64)
    return pair // tags, pair % tags


def boundary(s: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """The boundary of the union of regions, one for each tag, as pieces with the union on their left.

    A region is what an odd number of its segments parts from the outside, so overlaps within one tag cancel, and those
    of several tags count once.
    """
    s, tag = noded(s, tag)
    if not len(s):
        return s
    tags = int(tag.max()) + 1
    turned = (s[:, 0] > s[:, 2]) | ((s[:, 0] == s[:, 2]) & (s[:, 1] > s[:, 3]))
    s = np.where(turned[:, None], s[:, [2, 3, 0, 1]], s)
    # Each piece once for each tag that has it an odd number of times; then each piece once.
    rows, times = np.unique(np.column_stack((s, tag)), axis=0, return_counts=True)
    rows = rows[times % 2 == 1]
    if not len(rows):
        return s[:0]
    pieces, piece_of = np.unique(rows[:, :4], axis=0, return_inverse=True)
    own = np.unique(piece_of.ravel() * tags + rows[:, 4])  # piece and tag
    mid = np.stack((pieces[:, 0] + pieces[:, 2], pieces[:, 1] + pieces[:, 3]), axis=1)
    before = np.zeros(len(pieces), bool)
    after = np.zeros(len(pieces), bool)
    flat = pieces[:, 1] == pieces[:, 3]
    own_tags = np.ascontiguousarray(rows[:, 4])
    ways = [_Rising(2 * rows[:, c], own_tags) for c in ([0, 1, 2, 3], [1, 0, 3, 2])]
    for level in (False, True):  # pieces that rise are seen from the left, level ones from below
        which = np.flatnonzero(flat == level)
        x, y = (0, 1) if not level else (1, 0)
        query, of = _crossed(mid[which, x], mid[which, y], ways[level], ways[not level], tags)
        near = which[query] * tags + of
        before[near // tags] = True
        # Across the piece its own tags change sides.
        beyond = np.setxor1d(near, own[flat[own // tags] == level], assume_unique=True)
        after[beyond // tags] = True
    edge = before != after
    pieces, before, flat = pieces[edge], before[edge], flat[edge]
    # Pieces go right, or straight up. Left of one that goes up is before it, of one that goes down after it; a level one has below before it.
    goes_up = pieces[:, 3] > pieces[:, 1]
    left_inside = np.where(flat, ~before, np.where(goes_up, before, ~before))
    return np.where(left_inside[:, None], pieces, pieces[:, [2, 3, 0, 1]])


def twice_area(pieces: np.ndarray) -> int:
    """Twice the area within boundary pieces, exact at any size."""
    return sum(int(a) * int(d) - int(c) * int(b) for a, b, c, d in pieces.tolist())


def straightened(ring: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ring without points in the middle of straight lines."""
    out: list[tuple[int, int]] = []
    for p in ring:
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) == (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
            out.pop()
        out.append(p)
    while len(out) > 2 and (out[-1][0] - out[-2][0]) * (out[0][1] - out[-2][1]) == (out[-1][1] - out[-2][1]) * (out[0][0] - out[-2][0]):
        out.pop()
    while len(out) > 2 and (out[0][0] - out[-1][0]) * (out[1][1] - out[-1][1]) == (out[0][1] - out[-1][1]) * (out[1][0] - out[-1][0]):
        out.pop(0)
    return out


def _clockwise_first(back: tuple[int, int], ways: list[tuple[int, int]]) -> int:
    """Which of the directions comes first clockwise from back, exactly."""
    best, best_half = 0, 3
    for i, (x, y) in enumerate(ways):
        cross = back[0] * y - back[1] * x
        half = 0 if cross < 0 else 1 if cross == 0 else 2
        if half < best_half or (half == best_half and ways[best][0] * y - ways[best][1] * x > 0):
            best, best_half = i, half
    return best


def _walked(pieces: np.ndarray) -> list[list[tuple[int, int]]]:
    """Rings of boundary pieces, none of which meets itself: shells turn left, holes right.

    At a point where several pieces start, a walk takes the first clockwise from where it came, so it stays around one
    part; a walk that comes back to a point has closed a ring of its own.
    """
    rows, rings = pieces.tolist(), []
    starts = defaultdict(list)
    for k, (a, b, _, _) in enumerate(rows):
        starts[a, b].append(k)
    for first in range(len(rows)):
        k, path, place = first, [], {}
        while k is not None and k in starts[rows[k][0], rows[k][1]]:
            a, b, c, d = rows[k]
            starts[a, b].remove(k)
            if (a, b) not in place:
                place[a, b] = len(path)
                path.append((a, b))
            if (c, d) in place:  # a ring is closed
                at = place[c, d]
                rings.append(path[at:])
                for p in path[at + 1 :]:
                    del place[p]
                del path[at + 1 :]
            ways = starts[c, d]
            k = ways[_clockwise_first((a - c, b - d), [(rows[j][2] - c, rows[j][3] - d) for j in ways]) if len(ways) > 1 else 0] if ways else None
    return rings


def _ring_area(ring: list[tuple[int, int]]) -> int:
    return sum(a * d - c * b for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]))


def _within(x2: int, y2: int, ring: np.ndarray) -> bool:
    """Is the point (in half units) within the ring? It lies on no edge."""
    a, b = 2 * ring, 2 * np.roll(ring, -1, axis=0)
    up = np.where((a[:, 1] <= b[:, 1])[:, None], np.hstack((a, b)), np.hstack((b, a)))
    hit = (up[:, 1] <= y2) & (y2 < up[:, 3])
    return bool((_side(up[hit], np.full(hit.sum(), x2), np.full(hit.sum(), y2)) < 0).sum() % 2)


def polygons(pieces: np.ndarray) -> list[list[list[tuple[int, int]]]]:
    """Sound polygons of boundary pieces, each a shell and the holes in it; no ring repeats its first point."""
    shells, holes = [], []
    for ring in _walked(pieces):
        area = _ring_area(ring)
        if area:
            (shells if area > 0 else holes).append((abs(area), ring))
    shells.sort(key=lambda s: (s[0], s[1]))  # small ones first, so the first that holds a hole is its own
    out = [[straightened(ring)] for _, ring in shells]
    if not holes:
        return out
    grids = [np.array(ring, np.int64) for _, ring in shells]
    boxes = np.array([[*g.min(axis=0), *g.max(axis=0)] for g in grids], np.int64).reshape(-1, 4)
    areas = np.array([a for a, _ in shells], float)
    for area, hole in holes:
        (ax, ay), (bx, by) = hole[0], hole[1]
        x2, y2 = ax + bx, ay + by
        may = np.flatnonzero((2 * boxes[:, 0] <= x2) & (x2 <= 2 * boxes[:, 2]) & (2 * boxes[:, 1] <= y2) & (y2 <= 2 * boxes[:, 3]) & (areas >= area))
        at = may[0] if len(may) == 1 else next(i for i in may if _within(x2, y2, grids[i]))
        out[at].append(straightened(hole))
    return out


def segments(points: np.ndarray, sizes: list[int] | None = None) -> np.ndarray:
    """The edges of rings of these sizes (or of one ring), end to end, each closed."""
    sizes = [len(points)] if sizes is None else sizes
    ends = np.cumsum(sizes)
    after = np.arange(1, len(points) + 1)
    after[ends - 1] = ends - sizes
    return np.concatenate((points, points[after]), axis=1)
