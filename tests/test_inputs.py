import pytest

from voltaic.operators import inputs
from voltaic.schemas import POLYGONS, SchemaError


def square(side, x=0.0):
    return [[{"x": x + a * side, "y": b * side} for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))]]


def test_nodes(spark):
    raw = spark.createDataFrame([(-79.0, 43.0, "A"), (None, 44.0, "B")], "Longitude double, Latitude double, Location string")
    assert [r.node_id for r in inputs.nodes(raw).orderBy("node_id").collect()] == ["A", "B"]
    with pytest.raises(SchemaError, match="twice"):
        inputs.nodes(raw.union(raw))
    with pytest.raises(SchemaError, match="missing columns"):
        inputs.nodes(raw.drop("Latitude"))


def test_areas(spark):
    layer = spark.createDataFrame([("L1", [square(2.0)])], f"licence_no string, geometry {POLYGONS}")
    assert inputs.areas(layer) is layer
    for bad, what in ((layer.limit(0), "no features"), (layer.union(layer), "twice"), (spark.createDataFrame([("L1", [[square(1.0)[0][:2]]])], layer.schema), "unsound")):
        with pytest.raises(SchemaError, match=what):
            inputs.areas(bad)


def test_unmatched_and_log(spark):
    priced = spark.createDataFrame([("A",), ("B",), ("B",), (None,)], "node_id string")
    known = spark.createDataFrame([("A",)], "node_id string")
    missing = inputs.unmatched(priced, known, "node_id")
    assert [r[0] for r in missing.collect()] == ["B"]
    log = inputs.qa_entries(missing, "node_id", "1", "nodes", "no_coordinates", "n")
    assert sorted((r.record_id, r["count"]) for r in log.collect()) == [("B", 1), ("total", 1)]
    inputs.same_keys(known, known, "node_id")
    with pytest.raises(SchemaError, match="left"):
        inputs.same_keys(priced, known, "node_id")


def test_expect_one(spark):
    df = spark.createDataFrame([("North York",), ("York",)], "name string")
    assert inputs.expect_one(df, "name", "north").first()[0] == "North York"
    for part in ("york", "east"):
        with pytest.raises(SchemaError):
            inputs.expect_one(df, "name", part)


def test_dissolve_and_compare(spark):
    parts = spark.createDataFrame([("L1", [square(2.0)]), ("L1", [square(1.0, 10.0)]), ("L2", [square(3.0)])], f"licence_no string, geometry {POLYGONS}")
    whole = inputs.dissolve(parts, "licence_no")
    assert {r.licence_no: (len(r.geometry), r.n_source_features) for r in whole.collect()} == {"L1": (2, 2), "L2": (1, 1)}
    supplied = spark.createDataFrame([("L1", [square(2.0)]), ("L2", [square(3.0)])], parts.schema)
    got = inputs.compare_areas(whole, supplied)
    assert {r.licence_no: r.difference for r in got.collect()} == {"L1": 0.25, "L2": 0.0}
    assert inputs.worst(got).first().licence_no == "L1"
