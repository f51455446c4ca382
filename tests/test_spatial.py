"""Quadtree joins, spans by hulls and siblings by rings, against all pairs; chains of decisions against one by one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaic.functions import cover, geo
from voltaic.operators import decisions, spatial

SHAPE = "array<array<array<struct<x:double,y:double>>>>"


def closed(ring):
    return [{"x": float(x), "y": float(y)} for x, y in [*ring, ring[0]]]


@pytest.mark.parametrize("seed", range(3))
def test_inside_equals_a_test_of_every_pair(spark, seed):
    """Jagged shapes with holes, streets and countries, and points on corners, edges and cell borders."""
    r = random.Random(seed)
    shapes = []
    for k in range(12):
        wide = r.choice([3, 40, 900, 5000])
        cx, cy, n = r.randrange(-500, 500), r.randrange(-500, 500), r.choice([3, 5, 40, 400])
        ring = [(round(cx + wide * r.uniform(0.3, 1) * math.cos(2 * math.pi * i / n)), round(cy + wide * r.uniform(0.3, 1) * math.sin(2 * math.pi * i / n))) for i in range(n)]
        hole = [(cx, cy), (cx + wide // 8, cy), (cx, cy + wide // 8)]
        shapes.append((k, [[closed(ring), closed(hole)], [closed([(cx + 2 * wide, cy), (cx + 2 * wide + 8, cy), (cx + 2 * wide + 8, cy + 8)])]]))
    shapes += [(100, []), (101, None)]
    areas = spark.createDataFrame(shapes, f"k long, geometry {SHAPE}")
    places = [(i, float(r.randrange(-1200, 1200)), float(r.randrange(-1200, 1200))) for i in range(1500)]
    corners = [p for _, s in shapes[:12] for q in s for ring in q for p in ring]
    places += [(10_000 + i, p["x"], p["y"]) for i, p in enumerate(corners)] + [(9_999, None, 1.0)]
    points = spark.createDataFrame(places, "i long, x double, y double")
    want = points.join(areas, geo.covers(F.col("geometry"), F.col("x"), F.col("y"))).select("i", "k").collect()
    for cell in (1.0, 64.0):
        got = spatial.inside(points, areas, cell).select("i", "k").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_cells_grow_with_the_outline_not_the_area():
    ring = np.array([(0, 0), (1e6, 0), (1e6, 1e6), (0, 1e6)])
    few = cover.cells(np.hstack((ring, np.roll(ring, -1, axis=0))), 1.0)
    assert len(few) <= 4
    a = np.linspace(0, 2 * np.pi, 5000, endpoint=False)
    ring = np.stack((np.cos(a), np.sin(a)), axis=1) * 1e6
    own = cover.cells(np.hstack((ring, np.roll(ring, -1, axis=0))), 1.0)
    assert len(own) < 5000 and max(len(e) for *_, e in own) < 150 and any(n > 15 and odd and not len(e) for n, _, _, odd, e in own)
    street = cover.cells(np.hstack((ring * 1e-5, np.roll(ring * 1e-5, -1, axis=0))), 1.0)
    assert len(street) < 500


def test_spans_equal_those_of_all_pairs(spark):
    r = np.random.default_rng(4)
    rows = []
    for k, n, kind in (("one", 1, 0), ("two", 2, 0), ("line", 200, 1), ("circle", 500, 2), ("cloud", 2000, 0), ("same", 5, 3)):
        a = r.uniform(0, 2 * np.pi, n)
        xy = {0: r.normal(0, 1e4, (n, 2)), 1: np.outer(np.arange(n), (3.0, 4.0)), 2: 5e4 * np.stack((np.cos(a), np.sin(a)), axis=1), 3: np.ones((n, 2))}[kind]
        rows += [(k, x, y) for x, y in xy.tolist()]
    df = spark.createDataFrame([*rows, ("two", None, 1.0), (None, 1.0, 1.0)], "k string, x double, y double").repartition(5)
    got = {r.k: r.span_km for r in spatial.span_km(df, "k", most=100).collect()}
    for k in {k for k, _, _ in rows}:
        xy = np.array([(x, y) for j, x, y in rows if j == k])
        assert got.pop(k) == pytest.approx(np.sqrt(((xy[:, None] - xy) ** 2).sum(axis=2)).max() / 1000, rel=1e-12)
    assert not got


def test_a_million_points_of_one_key(spark):
    df = spark.range(1_000_000).select(F.lit("k").alias("k"), (F.col("id") % 1000).cast("double").alias("x"), F.floor(F.col("id") / 1000).cast("double").alias("y"))
    assert spatial.span_km(df, "k").first().span_km == pytest.approx(math.hypot(999, 999) / 1000)


def test_quarantine_equals_all_pairs(spark):
    r = random.Random(6)
    nodes = []
    for i in range(400):
        stem = r.choice(["A", "B", "C", "SOLO"]) if i else "ONE"
        lon, lat = (r.gauss(-80, 0.3), r.gauss(44, 0.3)) if r.random() < 0.8 else (r.uniform(-180, 180), r.uniform(-90, 90))
        nodes.append((f"{stem}{'' if stem == 'ONE' else ''}-LT.T{i}", lon, lat))
    nodes += [("A-LT.T1", -70.0, 44.0), ("NONE-LT.T", None, 3.0)]
    df = spark.createDataFrame(nodes, "Location string, Longitude double, Latitude double")
    from voltaic.functions.text import name_stem

    own = df.where("Longitude is not null").select("Location", "Longitude", "Latitude", name_stem(F.col("Location")).alias("s"))
    pairs = own.join(own.toDF("o", "x", "y", "s"), "s").where("Location <> o").groupBy("Location").agg(F.min(geo.haversine_km(F.col("Longitude"), F.col("Latitude"), F.col("x"), F.col("y"))).alias("km"))
    listed = ("A-LT.T2", "NONE-LT.T", nodes[0][0])
    for km in (5.0, 25.0, 900.0):
        want = {r.Location: r.km for r in df.select("Location").distinct().join(pairs, "Location", "left").where((F.col("km") > km) | F.col("Location").isin(*listed)).collect()}
        got = {r.Location: r.km for r in spatial.quarantine(df, listed, km).collect()}
        assert got == want and len(got) > 3


def test_a_stem_of_many_nodes(spark):
    """100,000 nodes in one place and some far away: no pair of the crowd is looked at."""
    crowd = spark.range(100_000).select(F.concat(F.lit("S-LT.T"), F.col("id").cast("string")).alias("Location"), (F.col("id") % 300 / 3000.0 - 80).alias("Longitude"), (F.floor(F.col("id") / 300) / 3000.0 + 44).alias("Latitude"))
    away = spark.createDataFrame([("S-LT.A", -81.0, 44.0), ("S-LT.B", 100.0, -44.0)], crowd.schema)
    got = {r.Location: r.km for r in spatial.quarantine(crowd.unionByName(away)).collect()}
    assert set(got) == {"S-LT.A", "S-LT.B"} and got["S-LT.A"] == pytest.approx(79.98, abs=0.1)


def one_by_one(licences, rows):
    """What applying decisions in order gives; None if one names a licence that isn't there."""
    out = {k: {"own": k, "area": 4.0**i, "decision": "none", "status": "", "excluded": False, "merged": [], "legacy": None, "stale": False} for i, k in enumerate(licences)}
    for lic, kind, target, status in rows:
        if lic not in out or (kind == "merge_into" and (target not in out or target == lic)) or (kind == "relicensed_as" and target in out):
            return None
        row = out[lic]
        if kind == "merge_into":
            into = out[target]
            into["area"] += row["area"]
            into["merged"].append(lic)
            into["decision"], into["status"] = "merge_target", status
            del out[lic]
            continue
        row["decision"], row["status"] = kind, status
        if kind == "relicensed_as":
            out[target] = out.pop(lic)
            out[target]["legacy"] = lic
        elif kind == "exclude_no_rrr":
            row["excluded"] = True
        else:
            row["stale"] = True
    return {(k, r["own"], r["area"], r["decision"], r["status"], r["excluded"], tuple(sorted(r["merged"])), r["legacy"], r["stale"]) for k, r in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_chains_equal_decisions_one_by_one(spark, seed):
    r = random.Random(seed)
    licences = [f"L{i}" for i in range(12)]
    rows, want = [], one_by_one(licences, [])
    for n in range(60):  # decisions that can be applied, each licence decided on once
        names = [*licences, *[t for _, k, t, _ in rows if k == "relicensed_as"]]
        lic, kind = r.choice(names), r.choice([*["merge_into"] * 3, "relicensed_as", "exclude_no_rrr", "unresolved_lookup"])
        target = {"merge_into": r.choice(names), "relicensed_as": f"N{n}"}.get(kind)
        more = [*rows, (lic, kind, target, r.choice(["final", "provisional"]))]
        if lic not in {x[0] for x in rows} and (found := one_by_one(licences, more)) is not None:
            rows, want = more, found
    assert len(rows) > 6
    layer = spark.createDataFrame([(k, k, [[closed([(i * 1000, 0), (i * 1000 + 2**i, 0), (i * 1000 + 2**i, 2**i), (i * 1000, 2**i)] if i < 9 else [(i * 10_000, 0), (i * 10_000 + 2**i, 0), (i * 10_000 + 2**i, 2**i), (i * 10_000, 2**i)])]]) for i, k in enumerate(licences)], f"licence_no string, utility_name string, geometry {SHAPE}")
    numbered = [(*x, n) for n, x in enumerate(rows)]
    r.shuffle(numbered)
    df = spark.createDataFrame(numbered, "licence_no string, decision string, target_licence_no string, status string, at int")
    assert decisions.untimely(df, "at").count() == 0
    got = decisions.apply(layer, df, "at").withColumn("area", geo.area(F.col("geometry"))).collect()
    assert {(x.licence_no, x.utility_name, x.area, x.decision, x.decision_status, x.excluded, tuple(x.merged_licences), x.legacy_licence_no, x.licence_not_current) for x in got} == want


def test_a_long_chain_and_decisions_out_of_time(spark):
    n = 100
    rows = [(f"L{i}", "merge_into", f"L{i + 1}", "final", i) for i in range(n)]
    schema = "licence_no string, decision string, target_licence_no string, status string, at int"
    ends = decisions.resolved(spark.createDataFrame(rows, schema)).collect()
    assert {(r.final_, r.merged_, r.from_) for r in ends} == {(f"L{n}", True, f"L{n - 1}")} and len(ends) == n
    late = [("A", "merge_into", "B", "final", 2), ("B", "relicensed_as", "C", "final", 1), ("D", "merge_into", "E", "final", 3)]
    assert [r.licence_no for r in decisions.untimely(spark.createDataFrame(late, schema), "at").collect()] == ["A"]


def test_nearest_points_of_crowded_places(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.uniform((-84, 43), (-82, 45), (300, 2)), rng.normal((-83, 44), 0.4, (300, 2)).round(2)
    monkeypatch.setattr(spatial, "CROWD", 4)  # several radii
    left = spark.createDataFrame([(i, *map(float, a[i % 300])) for i in range(600)], "c long, lon double, lat double")
    right = spark.createDataFrame([(i, *map(float, b[i % 300])) for i in range(900)], "s long, lon double, lat double")
    got = {r.c: (r.s, r.km) for r in spatial.nearest_point(left, right, "c", "s", 30.0).collect()}
    (lon, lat), (lon2, lat2) = np.radians(a).T, np.radians(b).T
    h = np.sin((lat[:, None] - lat2) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat2) * np.sin((lon[:, None] - lon2) / 2) ** 2
    km = 2 * geo.EARTH_KM * np.arcsin(np.sqrt(h))
    assert set(got) == {i for i in range(600) if km[i % 300].min() <= 30}
    for i, (s, d) in got.items():
        near = km[i % 300]
        assert abs(d - near.min()) < 1e-6 and s < 300 and abs(near[s] - near.min()) < 1e-6


def test_nearest_points_of_one_place_are_one(spark):
    def at_one(key):  # 10**10 pairs
        return spark.range(100_000).select(F.col("id").alias(key), F.lit(-80.0).alias("lon"), F.lit(44.0).alias("lat"))

    got = spatial.nearest_point(at_one("c"), at_one("s"), "c", "s", 60.0)
    assert got.agg(F.count("*"), F.max("s"), F.max("km")).first() == (100_000, 0, 0.0)


def test_nearest_measures_few_points(spark):
    rng = np.random.default_rng(4)
    xy = rng.uniform(-60, 60, (400, 2))
    rings = {"wide": [(0, 0), (30, 0), (30, 30), (0, 30), (0, 0)], "tiny": [(-40, -40), (-39.9, -40), (-39.9, -39.9), (-40, -40)], "far": [(500, 0), (501, 0), (501, 1), (500, 0)], "hook": [(-50, 10), (-20, 10), (-20, 50), (-21, 50), (-21, 11), (-50, 11), (-50, 10)]}
    areas = spark.createDataFrame([(k, [[[{"x": float(p), "y": float(q)} for p, q in r]]]) for k, r in rings.items()] + [("none", []), ("null", None)], "k string, geometry array<array<array<struct<x:double,y:double>>>>")
    points = spark.createDataFrame([(f"n{i:04d}", *map(float, xy[i % 400])) for i in range(800)] + [("x", None, 1.0)], "name string, x double, y double")
    every = points.where("x is not null").crossJoin(areas).withColumn("distance", geo.distance(F.col("geometry"), F.col("x"), F.col("y"))).where("distance <= 25")
    expected = every.groupBy("k").agg(F.min(F.struct("distance", "name")).alias("b")).select("k", "b.name", "b.distance")
    out = spatial.nearest(areas, points, "k", "name", 25.0)
    assert sorted(out.collect()) == sorted(expected.collect())
    assert {r.k for r in out.collect()} == {"wide", "tiny", "hook"}
