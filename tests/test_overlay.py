"""Repair, union and dissolve of polygons: known areas, random shapes against point-by-point tests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaic.functions import geo, overlay, planar
from voltaic.operators import inputs
from voltaic.operators import overlay as dissolving

SCHEMA = f"k string, geometry {overlay.SHAPE}"


def shape(*polygons):
    """Polygons as lists of rings of (x, y), closed here."""
    return [[[{"x": float(x), "y": float(y)} for x, y in [*ring, ring[0]]] for ring in p] for p in polygons]


def box(x, y, wide, high):
    return [(x, y), (x + wide, y), (x + wide, y + high), (x, y + high)]


BOW_TIE = [(0, 0), (4, 4), (4, 0), (0, 4)]
CASES = {  # polygons, area, polygons and rings after repair, was it broken?
    "sound": (shape([box(0, 0, 4, 2)]), 8.0, 1, 1, False),
    "hole": (shape([box(0, 0, 10, 10), box(2, 2, 3, 3)]), 91.0, 1, 2, False),
    "bow-tie": (shape([BOW_TIE]), 8.0, 2, 2, True),
    "spike": (shape([[(0, 0), (4, 0), (9, 0), (4, 0), (4, 4), (0, 4)]]), 16.0, 1, 1, True),
    "repeated point": (shape([[(0, 0), (4, 0), (4, 0), (4, 4), (0, 4)]]), 16.0, 1, 1, False),
    "nested shells": (shape([box(0, 0, 10, 10)], [box(2, 2, 5, 5)]), 75.0, 1, 2, True),
    "three nested shells": (shape([box(0, 0, 10, 10)], [box(1, 1, 8, 8)], [box(2, 2, 2, 2)]), 40.0, 2, 3, True),
    "overlapping shells": (shape([box(0, 0, 4, 4)], [box(2, 2, 4, 4)]), 24.0, 2, 2, True),
    "hole across the shell": (shape([box(0, 0, 4, 4), box(2, 1, 4, 2)]), 16 - 4 + 4.0, 2, 2, True),
    "hole outside": (shape([box(0, 0, 4, 4), box(10, 10, 1, 1)]), 17.0, 2, 2, True),
    "shell twice": (shape([box(0, 0, 4, 4)], [box(0, 0, 4, 4)]), 0.0, 0, 0, True),
    "hole at a corner of the shell": (shape([box(0, 0, 4, 4), [(0, 0), (2, 1), (1, 2)]]), 14.5, 1, 2, False),
    "ring that touches itself": (shape([[(0, 0), (4, 0), (4, 4), (2, 4), (2, 2), (3, 3), (1, 3), (2, 2), (2, 4), (0, 4)]]), 15.0, 1, 2, True),
    "line": (shape([[(0, 0), (4, 4), (8, 8)]]), 0.0, 0, 0, True),
    "two points": (shape([[(0, 0), (1, 1)]]), 0.0, 0, 0, True),
    "not a number": (shape([box(0, 0, 2, 2)], [[(0, 0), (float("nan"), 1), (2, 2)]]), 4.0, 1, 1, True),
    "empty": ([], 0.0, 0, 0, False),
}


def test_repairs_have_known_areas(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in CASES.items()] + [("null", None)], SCHEMA)
    r = overlay.repaired(F.col("geometry"))
    got = {x.k: (x.a, x.p, x.r, x.b) for x in df.select("k", r.alias("s")).select("k", geo.area(F.col("s.geometry")).alias("a"), F.size("s.geometry").alias("p"), F.size(F.flatten("s.geometry")).alias("r"), F.col("s.repaired").alias("b")).collect()}
    assert got.pop("null") == (None, None, None, None)
    assert got == {k: c[1:] for k, c in CASES.items()}


def test_repairs_are_sound(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in CASES.items()], SCHEMA)
    layer, broken = inputs.repaired(df, "k")
    assert sorted(r.k for r in broken.collect()) == sorted(k for k, c in CASES.items() if c[4])
    again, rest = inputs.repaired(layer, "k")
    assert rest.count() == 0
    assert layer.where(F.size("geometry") > 0).where("k <> 'repeated point'").where(F.size(geo.problems(F.col("geometry"))) > 0).count() == 0
    sound = {r.k: r.geometry for r in layer.collect()}["hole"]
    assert [[[p.asDict() for p in r] for r in q] for q in sound] == CASES["hole"][0]  # as it was, point by point


def even_odd(rings, x, y):
    n = np.zeros(len(x), int)
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, np.roll(r, -1, axis=0)):
            if y1 != y2:
                n += ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return n % 2 == 1


@pytest.mark.parametrize("seed", range(60))
def test_unions_cover_what_their_parts_cover(seed):
    """Random crossing rings on coarse grids, so that many points and edges coincide."""
    r = np.random.default_rng(seed)
    wide = r.choice([5, 30, 1000])
    parts = [[r.integers(0, wide, (r.integers(3, 12), 2)).astype(float) for _ in range(r.integers(1, 3))] for _ in range(r.integers(1, 6))]
    polygons, grid = overlay.merged(parts)
    out = [[np.array([(p["x"], p["y"]) for p in ring[:-1]]) for ring in p] for p in overlay.plain(polygons, grid)]
    x, y = r.uniform(-1, wide + 1, (2, 1500))
    want = np.zeros(1500, bool)
    for p in parts:
        want |= even_odd(p, x, y)
    inside = sum(even_odd(p, x, y).astype(int) for p in out) if out else np.zeros(1500, int)
    assert inside.max(initial=0) <= 1  # polygons don't overlap
    assert (want != (inside > 0)).sum() <= 2  # but for points within the grid's step of an edge
    closed = [[np.vstack((ring, ring[:1])) for ring in p] for p in out]
    again, at = overlay.merged([[ring for p in closed for ring in p]])
    assert not out or overlay.is_sound(closed, again, at)


def test_areas_are_exact():
    """Twice the area in whole numbers, of boxes at the far ends of the grid."""
    a = planar.segments(np.array(box(-planar.REACH, -planar.REACH, 2 * planar.REACH, 2 * planar.REACH), np.int64))
    b = planar.segments(np.array(box(-5, -5, 10, 7), np.int64))
    both = np.concatenate((a, b))
    assert planar.twice_area(planar.boundary(both, np.repeat([0, 1], 4))) == 2 * (2 * planar.REACH) ** 2
    assert planar.twice_area(planar.boundary(both, np.zeros(8, int))) == 2 * ((2 * planar.REACH) ** 2 - 70)


def test_dissolve_counts_overlaps_once(spark):
    rows = [("a", shape([box(0, 0, 4, 4)])), ("a", shape([box(2, 2, 4, 4)])), ("a", None), ("b", shape([box(0, 0, 1, 1)], [box(5, 5, 1, 1)])), ("b", shape([box(1, 0, 1, 1)])), ("c", None), (None, shape([box(0, 0, 2, 2)]))]
    got = {r.k: (r.a, r.n_source_features, r.p) for r in inputs.dissolve(spark.createDataFrame(rows, SCHEMA), "k").select("k", "n_source_features", geo.area(F.col("geometry")).alias("a"), F.size("geometry").alias("p")).collect()}
    assert got == {"a": (28.0, 3, 1), "b": (3.0, 2, 2), "c": (0.0, 1, 0), None: (4.0, 1, 1)}
    assert inputs.dissolve(spark.createDataFrame([], SCHEMA), "k").count() == 0


def test_a_key_of_many_parts_is_merged_in_rounds(spark, monkeypatch):
    """A carpet of overlapping boxes under one key, merged a few at a time."""
    monkeypatch.setattr(dissolving, "FEW", 3)
    i, j = F.col("id") % 30, F.floor(F.col("id") / 30)
    corner = [(0, 0), (12, 0), (12, 12), (0, 12), (0, 0)]
    ring = F.array(*[F.struct((i * 10 + a).cast("double").alias("x"), (j * 10 + b).cast("double").alias("y")) for a, b in corner])
    parts = spark.range(900).select((F.col("id") >= 0).cast("string").alias("k"), F.array(F.array(ring)).alias("geometry"))
    got = dissolving.dissolve(parts, "k", points=60).select(geo.area(F.col("geometry")), F.size("geometry"), F.size(F.flatten("geometry"))).collect()
    assert [tuple(r) for r in got] == [(302.0**2, 1, 1)]


def test_rows_and_columns_of_parts_are_not_looked_at_pair_by_pair(monkeypatch):
    looked = []
    whole = planar._side
    monkeypatch.setattr(planar, "_side", lambda s, x, y: looked.append(len(s)) or whole(s, x, y))
    n, gap = 2000, np.arange(2000) * 20
    for wide, high in ((20, 5000), (5000, 20), (10, 5000), (5000, 10)):  # side by side, and with gaps
        parts = [[np.array(box(*((x, 0) if high == 5000 else (0, x)), wide, high), float)] for x in gap]
        looked.clear()
        got, _ = overlay.merged(parts, 1.0)
        assert len(got) == (1 if 20 in (wide, high) else n) and sum(looked) < 200 * n


def test_shapes_merge_side_by_side_as_alone():
    rng = np.random.default_rng(5)
    shapes = [[[rng.uniform(-r, r, (int(rng.integers(3, 8)), 2)) for _ in range(2)] for _ in range(int(rng.integers(0, 3)))] for r in rng.choice([1.0, 30.0, 2e5], 150)]
    alone = [overlay.plain(*overlay.merged(s)) for s in shapes]
    for points in (1, 40, 50_000):
        assert [overlay.plain(*m) for m in overlay.merged_each(shapes, points=points)] == alone


def test_repairs_of_a_batch_node_once(monkeypatch):
    calls = []
    whole = planar.boundary
    monkeypatch.setattr(planar, "boundary", lambda s, tag: calls.append(1) or whole(s, tag))
    overlay.merged_each([[[np.array(BOW_TIE, float)]]] * 500)
    assert len(calls) == 1
