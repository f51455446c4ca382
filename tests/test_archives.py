"""Workbooks and zipped maps as partitioned data sources."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from test_counts import workbook
from voltaic.sources import archives


def kml(name):
    ring = "<LinearRing><coordinates>0,0,0 2,0,0 2,2,0 0,0,0</coordinates></LinearRing>"
    table = "<![CDATA[<table><tr><td>Licence</td><td>L-" + name + "</td></tr></table>]]>"
    return f'<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>{name}</name><description>{table}</description><Polygon><outerBoundaryIs>{ring}</outerBoundaryIs></Polygon></Placemark></Document></kml>'


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "."), content)
    return out.getvalue()


@pytest.fixture
def registered(spark):
    archives.register(spark)
    return spark


def test_a_partition_for_each_sheet(registered, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.xlsx").write_bytes(workbook({"One": [["t"], ["k", "v"], ["1", "x"], [None, None], ["2", None]], "Two": [["t"], ["v", "k"], ["y", "3"]]}))
    (tmp_path / "deep" / "b.xlsx").write_bytes(workbook({"One": [["t"], ["k", "v", "w"], ["4", "z", "w"]]}))
    read = registered.read.format("voltaic_xlsx").option("header", "2")
    df = read.schema("v string, k string, sheet string, file string").load(str(tmp_path))
    assert sorted(map(tuple, df.collect()), key=repr) == [("x", "1", "One", "a.xlsx"), ("y", "3", "Two", "a.xlsx"), ("z", "4", "One", "b.xlsx"), (None, "2", "One", "a.xlsx")]
    assert df.rdd.getNumPartitions() == 3
    assert read.schema("k string").option("sheet", "One").load(f"file://{tmp_path}").count() == 3
    own = df.where("sheet = 'Two' and file = 'a.xlsx'")
    assert own.rdd.getNumPartitions() == 1 and [r.k for r in own.collect()] == ["3"]
    assert df.where(F.col("file").isin("b.xlsx", "c.xlsx")).count() == 1 and df.where("file = 'none'").count() == 0
    with pytest.raises(Exception, match="missing columns"):
        read.schema("gone string").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="needs a schema"):
        registered.read.format("voltaic_xlsx").load(str(tmp_path))


def test_a_partition_for_each_map(registered, tmp_path):
    (tmp_path / "a.kmz").write_bytes(zipped(doc__kml=kml("A"), more__kml=kml("B"), icon__png=b"x"))
    (tmp_path / "b.zip").write_bytes(zipped(map__kmz=zipped(doc__kml=kml("C")), read__txt="x"))
    df = registered.read.format("voltaic_kmz").option("fields", "Licence").load(str(tmp_path))
    assert sorted((r["name"], r.Licence, r.file, r.member, len(r.geometry[0][0])) for r in df.collect()) == [("A", "L-A", "a.kmz", "doc.kml", 4), ("B", "L-B", "a.kmz", "more.kml", 4), ("C", "L-C", "b.zip", "doc.kml", 4)]
    assert df.rdd.getNumPartitions() == 3 and df.where("member = 'more.kml'").rdd.getNumPartitions() == 1
    assert registered.read.format("voltaic_kmz").schema("Licence string").load(str(tmp_path)).columns == ["Licence"]


def test_the_first_copy_is_kept(registered, tmp_path):
    one, two = zipped(doc__kml=kml("A")), zipped(doc__kml=kml("B"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.zip").write_bytes(zipped(map__kmz=one))
    (tmp_path / "in" / "none.zip").write_bytes(zipped(read__txt="x"))
    assert [(r.name, r.kept) for r in archives.retain(registered, str(tmp_path / "in"), str(tmp_path / "kept")).collect()] == [("map.kmz", True)]
    (tmp_path / "in" / "x.zip").write_bytes(zipped(map__kmz=two))
    assert [(r.name, r.kept) for r in archives.retain(registered, str(tmp_path / "in"), str(tmp_path / "kept")).collect()] == [("map.kmz", False)]
    assert (tmp_path / "kept" / "map.kmz").read_bytes() == one and [p.name for p in (tmp_path / "kept").iterdir() if p.suffix != ".crc"] == ["map.kmz"]
