import io
import json
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from voltaic.operators import tariff, value
from voltaic.operators.merge import files_to_fetch, keep_last
from voltaic.plans import report
from voltaic.schemas import HOLIDAYS, SchemaError
from voltaic.sources import policy, readers, sinks, versions
from voltaic.streaming import incremental


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_zonal_xml(spark, tmp_path):
    hours = "".join(f"<HourlyPriceComponents><PricingHour>{h}</PricingHour><ZonalPrice>{p}</ZonalPrice></HourlyPriceComponents>" for h, p in ((1, "10.5"), (2, " "), (24, "-3")))
    path = put(tmp_path / "z.xml", f'<?xml version="1.0"?><Document xmlns="http://example.org/s"><DocBody><DeliveryDate>2026-07-15</DeliveryDate>{hours}</DocBody></Document>')
    got = readers.zonal_prices(spark, path).select(F.col("timestamp_utc").cast("string"), "price")
    assert rows(got, "timestamp_utc") == [("2026-07-15 05:00:00", 10.5), ("2026-07-16 04:00:00", -3.0)]


def test_fuel_xml(spark, tmp_path):
    fuel = lambda n, v: f"<FuelTotal><Fuel>{n}</Fuel><EnergyValue>{v}</EnergyValue></FuelTotal>"
    hour = lambda h, *f: f"<HourlyData><Hour>{h}</Hour>{''.join(f)}</HourlyData>"
    body = hour(1, fuel("NUCLEAR", "<Output>5</Output>"), fuel("SOLAR", "<OutputQuality>-1</OutputQuality>")) + hour(2, fuel("SOLAR", "<Output>7</Output>"), fuel("CONTROL_ACTIONS", "<Output>9</Output>"))
    path = put(tmp_path / "f.xml", f"<Document><DocBody><DailyData><Day>2026-07-15</Day>{body}</DailyData></DocBody></Document>")
    got = readers.fuel_mix(spark, path)
    assert sorted(got.columns) == ["nuclear", "solar", "timestamp_utc"]
    assert rows(got.select("nuclear", "solar"), "timestamp_utc") == [(5.0, None), (None, 7.0)]


def test_rates_csv(spark, tmp_path):
    put(tmp_path / "a.csv", "﻿Date,Hour,Status,LFDC Rate ($/MWh)\n2026-07-20,14,final,1.25\n2026-07-20,15,final,\n2026-07-20,x,final,1\n2026-07-20,16,final,abc\n2026-07-20,99,final,3\n")
    put(tmp_path / "b.csv", 'Date,Hour,"LFDA Rate ($/MWh)",Status\n2025-01-01,1,2.5,p\n')
    got = readers.adjustment_rates(spark, str(tmp_path)).select(F.col("timestamp_utc").cast("string"), "rate", "status")
    assert rows(got, "timestamp_utc") == [("2025-01-01 05:00:00", 2.5, "p"), ("2026-07-20 18:00:00", 1.25, "final")]
    put(tmp_path / "d.csv", 'Note,Date,Hour,"LFDA Rate ($/MWh)",Status\n"a, ""b""",2025-02-01,1,"3.5","x, y"\n,2025-02-01,2, ,z\n')
    got = readers.adjustment_rates(spark, str(tmp_path / "d.csv")).select("rate", "status")
    assert rows(got) == [(3.5, "x, y")]
    assert sorted((r.file[-5:], r.n_blank) for r in readers.blank_rates(spark, str(tmp_path)).collect()) == [("a.csv", 1), ("d.csv", 1)]
    put(tmp_path / "c.csv", "Date,Hour\n2025-01-01,1\n")
    with pytest.raises(Exception, match="no rate column"):
        readers.adjustment_rates(spark, str(tmp_path)).collect()


def test_files_are_read_in_portions(spark, tmp_path):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    rates = put(tmp_path / "r.csv", "Date,Hour,Status,LFDC Rate ($/MWh)\r\n" + "".join(f"2026-07-20,{i % 24 + 1},s{i},{i}\r\n{chr(10) if i % 9 == 0 else ''}" for i in range(500)))
    prices = put(tmp_path / "p.csv", "AT 2026/07/14 FOR 2026/07/15\nDelivery Hour,Pricing Location,LMP,Energy Loss Price,Energy Congestion Price\n" + "".join(f"{i % 24 + 1},N{i},{i},,1\n" for i in range(500)))
    try:
        for size in ("128m", "900b", "40b"):  # at the last, heads are in several portions
            spark.conf.set(name, size)
            got = readers.adjustment_rates(spark, rates).withColumn("task", F.spark_partition_id()).collect()
            assert sorted((r.row, r.rate, r.status) for r in got) == [(i + (i + 8) // 9, float(i), f"s{i}") for i in range(500)]
            nodal = readers.nodal_prices(spark, prices).withColumn("task", F.spark_partition_id()).collect()
            assert sorted((r.lmp, r.node_id, r.loss, r.congestion) for r in nodal) == [(float(i), f"N{i}", None, 1.0) for i in range(500)]
            if size == "900b":
                assert len({r.task for r in got}) > 5 and len({r.task for r in nodal}) > 5
    finally:
        spark.conf.set(name, before)


def test_nodal_csv(spark, tmp_path):
    path = put(tmp_path / "n.csv", "CREATED AT 2026/07/14 13:00:00 FOR 2026/07/15\nDelivery Hour,Pricing Location,LMP,Energy Loss Price,Energy Congestion Price\n1,A:LMP,10,1,\n24,A:LMP,,2,3\n")
    got = readers.nodal_prices(spark, path).select("node_id", F.col("date").cast("string"), F.col("timestamp_utc").cast("string"), "lmp", "loss", "congestion")
    assert rows(got, "timestamp_utc") == [("A:LMP", "2026-07-15", "2026-07-15 05:00:00", 10.0, 1.0, None), ("A:LMP", "2026-07-15", "2026-07-16 04:00:00", None, 2.0, 3.0)]
    path = put(tmp_path / "o.csv", "CREATED AT 2026/07/14 13:00:00 FOR 2026/07/15\nDelivery Hour, Pricing Location,LMP,Energy Loss Price,Energy Congestion Price\n10, B1 ,22.22,3.3,40.4\n")
    assert rows(readers.nodal_prices(spark, path).select("node_id", "lmp", "loss", "congestion")) == [("B1", 22.22, 3.3, 40.4)]  # digits at ends stay
    with pytest.raises(Exception, match="no delivery date"):
        readers.nodal_prices(spark, put(tmp_path / "m.csv", "CREATED\nDelivery Hour,Pricing Location,LMP\n1,A,2\n")).collect()


def test_regulator_xml(spark, tmp_path, caplog):
    one = "<tab1><Current_Company_Name>A</Current_Company_Name><Year>2024</Year></tab1>"
    two = "<tab1><Current_Company_Name>B</Current_Company_Name><Historical_Company_Name>Old</Historical_Company_Name><Year>2024</Year><N_x0028_kW_x0029_>1,5</N_x0028_kW_x0029_></tab1>"
    path = put(tmp_path / "t.xml", f"<dataroot>{one}{two}</dataroot>")
    got = readers.regulator_table(spark, path, "tab1", ["Current_Company_Name", "N_x0028_kW_x0029_"])
    assert rows(got.select("Current_Company_Name", "N_x0028_kW_x0029_"), "Current_Company_Name") == [("A", None), ("B", "1,5")]
    with pytest.raises(SchemaError, match="missing columns"):
        readers.regulator_table(spark, path, "tab1", ["Gone"])
    with pytest.raises(SchemaError, match="no records"):
        readers.regulator_table(spark, put(tmp_path / "e.xml", "<dataroot></dataroot>"), "tab1", [])
    put(tmp_path / "u.xml", "<dataroot><tab2><Current_Company_Name>C</Current_Company_Name><Historical_Company_Name>Old</Historical_Company_Name></tab2><tab2><Year>1</Year></tab2></dataroot>")
    current, former = readers.regulator_names(spark, str(tmp_path / "[tu].xml"))
    assert rows(current, "name") == [("A",), ("B",), ("C",)] and rows(former) == [("Old", "B")]
    with caplog.at_level("WARNING"):
        assert [x.count() for x in readers.regulator_names(spark, str(tmp_path / "gone*.xml"))] == [0, 0]
    assert "no regulator tables" in caplog.text


def test_csv_schema(spark, tmp_path):
    path = put(tmp_path / "h.csv", "date,name,note\n2026-01-01,New Year,\n")
    assert readers.csv_table(spark, path, HOLIDAYS).first()["name"] == "New Year"
    with pytest.raises(Exception):
        readers.csv_table(spark, put(tmp_path / "bad.csv", "day,name,note\n2026-01-01,x,\n"), HOLIDAYS).collect()


SQUARE = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]


def test_geojson_round_trip(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"licence_no": "L1", "n": 2}, "geometry": {"type": "Polygon", "coordinates": [SQUARE]}}, {"type": "Feature", "properties": {"licence_no": "L2"}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE], [SQUARE, SQUARE]]}}]}
    got = readers.geojson(spark, put(tmp_path / "g.json", json.dumps(doc)))
    assert [(r.licence_no, r.n, len(r.geometry)) for r in got.orderBy("licence_no").collect()] == [("L1", "2", 1), ("L2", None, 2)]
    sinks.write_geojson(got, str(tmp_path / "out.json"), ["licence_no"])
    again = readers.geojson(spark, str(tmp_path / "out.json"))
    assert rows(again.select("licence_no", "geometry"), "licence_no") == rows(got.select("licence_no", "geometry"), "licence_no")


def test_kmz(spark, tmp_path):
    table = "<![CDATA[<table><tr><td>Licence</td><td>ED-1 &amp; 2</td></tr></table>]]>"
    ring = "<LinearRing><coordinates>0,0,0 2,0,0 2,2,0 0,0,0</coordinates></LinearRing>"
    kml = f'<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>P</name><description>{table}</description><Polygon><outerBoundaryIs>{ring}</outerBoundaryIs><innerBoundaryIs>{ring}</innerBoundaryIs></Polygon></Placemark></Document></kml>'
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("doc.kml", kml)
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.writestr("map.kmz", inner.getvalue())
    r = readers.kmz(spark, str(tmp_path / "outer.zip"), ["Licence", "Other"]).first()
    assert (r["name"], r.Licence, r.Other, len(r.geometry[0]), len(r.geometry[0][0])) == ("P", "ED-1 & 2", None, 2, 4)


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Contract Data" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Fuel</t></si><si><r><t>So</t></r><r><t>lar</t></r></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row><c r="A1"/></row><row/><row><c r="A3" t="s"><v>0</v></c><c r="C3" t="inlineStr"><is><t>MW</t></is></c></row><row><c r="A4" t="s"><v>1</v></c><c r="C4"><v>1.5</v></c></row></sheetData></worksheet>')
    assert rows(readers.xlsx(spark, str(tmp_path / "b.xlsx"), "Contract Data", ["Fuel", "MW"])) == [("Solar", "1.5")]
    with pytest.raises(Exception, match="missing columns"):
        readers.xlsx(spark, str(tmp_path / "b.xlsx"), "Contract Data", ["Gone"]).collect()


def test_links_and_listing(spark, tmp_path):
    html = spark.createDataFrame([('<a href="F_20260101.xml">x</a><a href="F_20260101_v2.xml">y</a><a href="G.xml">z</a>',)], "html string")
    assert rows(readers.index_links(html, "F_"), "name") == [("F_20260101.xml",), ("F_20260101_v2.xml",)]
    put(tmp_path / "one.txt", "abc")
    r = readers.listing(spark, str(tmp_path)).first()
    assert (r["name"], r["size"], r.sha256[:8]) == ("one.txt", 3, "ba7816bf")
    links = spark.createDataFrame([("t1", "2023", "ED a", "u1"), ("t1", "2024", "b", "u2"), ("t1", "2024", "ED c", "u3")], "dataset string, vintage string, name string, url string")
    assert rows(readers.newest_datasets(links)) == [("t1", "u3")]


def test_qa_log_replaces_namespaces(spark, tmp_path):
    path = str(tmp_path / "qa")
    entry = lambda *e: spark.createDataFrame(list(e), "phase string, dataset string, action string, record_id string, count long, note string")
    sinks.log_rows(entry(("1", "a", "x", "r", 1, "n"), ("1", "a", "x", "r", 1, "n"), ("1", "b", "y", "r", 2, "n")), path)
    sinks.log_rows(entry(("1", "a", "z", "q", 3, "m")), path)
    assert [(r.dataset, r.action) for r in sinks.read_log(spark, path).collect()] == [("a", "z"), ("b", "y")]


def test_small_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    sinks.write_csv(df, str(tmp_path / "c"), ["v", "k"], ["k"])
    assert rows(spark.read.csv(str(tmp_path / "c"), header=True)) == [("a", "1"), ("b", "2")]
    assert sinks.one_row_json(df.where("k = 1"), str(tmp_path / "j.json")) == {"k": 1, "v": "a"} == json.loads((tmp_path / "j.json").read_text())
    with pytest.raises(ValueError):
        sinks.one_row_json(df, str(tmp_path / "j.json"))
    manifest = spark.createDataFrame([("f", 1)], "name string, mtime int")
    assert rows(sinks.update_manifest(manifest, spark.createDataFrame([("f", 2), ("g", 1)], "name string, mtime int")), "name") == [("f", 2), ("g", 1)]


def test_incremental_stream(spark, tmp_path):
    schema = "node string, day string, lmp double, seq int"
    run = lambda: incremental.accumulate(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"), ["node"], "seq", "day").awaitTermination()
    add = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add(("A", "d1", 1.0, 1), ("A", "d1", 2.0, 2), ("B", "d2", 5.0, 1))
    run()
    add(("A", "d1", 9.0, 1), ("C", "d1", 3.0, 1))
    run()
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("node", "lmp", "day"), "node") == [("A", 9.0, "d1"), ("B", 5.0, "d2"), ("C", 3.0, "d1")]


def test_a_key_that_changes_its_day(spark, tmp_path):
    schema = "node string, day string, lmp double, seq int"
    run = lambda: incremental.accumulate(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"), ["node"], "seq", "day").awaitTermination()
    add = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add(("A", "d1", 1.0, 1), ("B", "d1", 2.0, 1), ("C", "d3", 3.0, 1))
    run()
    add(("A", "d2", 4.0, 1), ("C", "d2", 5.0, 1))
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("node", "lmp", "day"), "node") == [("A", 4.0, "d2"), ("B", 2.0, "d1"), ("C", 5.0, "d2")]


@pytest.mark.parametrize("step", range(4))
def test_a_stream_killed_while_it_publishes(spark, tmp_path, monkeypatch, step):
    """Days deleted or half written by a run that dies come back from what was staged."""
    schema = "node string, day string, lmp double, seq int"
    run = lambda: incremental.accumulate(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"), ["node"], "seq", "day").awaitTermination()
    add = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add(("A", "d1", 1.0, 1), ("B", "d1", 2.0, 1), ("C", "d3", 3.0, 1))
    run()
    add(("A", "d1", 4.0, 1), ("C", "d2", 5.0, 1))
    real, calls = versions.exists, []

    def dies(own, path):
        if step == 0:
            raise OSError("killed")
        return real(own, path)

    def delete(own, path):
        calls.append(path)
        if len(calls) == 1 and step:
            if step > 1:  # as an overwrite that got no further than to delete
                shutil.rmtree(tmp_path / "out" / "day=d1", ignore_errors=True)
            if step > 2:
                shutil.rmtree(tmp_path / "out" / "day=d2", ignore_errors=True)
            raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(versions, "exists", dies)
        m.setattr(versions, "delete", delete)
        with pytest.raises(Exception, match="killed"):
            run()
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("node", "lmp", "day"), "node") == [("A", 4.0, "d1"), ("B", 2.0, "d1"), ("C", 5.0, "d2")]


def test_keep_last_of_nothing(spark):
    assert keep_last(spark.createDataFrame([], "k int, v int"), ["k"], "v").count() == 0


def test_report(spark):
    signal = spark.createDataFrame([(f"L{i}", f"u{i}", float(i), "approved", i > 7) for i in range(10)], "licence_no string, utility_name string, mean_premium double, owner_status string, heterogeneous boolean")
    told = spark.createDataFrame([(f"L{i}", True, float(i * i), False, f"u{i}") for i in range(10)], "licence_no string, reported boolean, capacity_per_1000_customers_mw double, multi_zone boolean, utility_name string")
    page = report.correlation_page(signal, told)
    assert (page["n"], page["hollow"], page["rho"]) == (8, 2, "rho = 1.00 (n = 8)")
    assert report.correlation_page(signal.limit(6), told)["rho"] == ""
    assert report.correlation_page(signal.limit(0), told) is None
    layer = report.map_layer(told, "capacity_per_1000_customers_mw")
    assert layer == report.map_layer(told.orderBy(F.desc("licence_no")), "capacity_per_1000_customers_mw") and "NaN" not in layer


def test_markdown_and_gate():
    assert report.markdown("# A & b\n\n- **x**\n- `y`\n\n<script> [l](https://e.org)") == '<h1>A &amp; b</h1>\n<ul><li><strong>x</strong></li><li><code>y</code></li></ul>\n<p>&lt;script&gt; <a href="https://e.org">l</a></p>'
    doc = report.page("T", "x")
    shut = report.gated(doc, False)
    assert shut != doc and report.gated(shut, False) == shut and report.gated(shut, True) == doc


def test_status_panel(spark):
    values = spark.sql("select timestamp'2026-01-01' + make_dt_interval(0, id) as timestamp_utc, 40.0 as energy_price, 10.0 as tou_wedge from range(72) where id not between 24 and 47")
    assigned = spark.createDataFrame([("A", "Z"), ("B", None)], "node_id string, zone string")
    signal = spark.createDataFrame([("in_polygon", "approved", False), ("none", "rejected", True)], "method string, owner_status string, heterogeneous boolean")
    got = report.status(values, assigned, signal, spark.createDataFrame([(True,), (False,)], "reported boolean"))
    assert got["window"]["hours"] == 48 and got["zoned_share"] == 0.5 and got["methods"] == {"in_polygon": 1, "none": 1}
    assert [str(d) for d in got["gaps"]["day"]] == ["2026-01-02"] and got["history"]["days"] == 2 and got["reported"] == got["heterogeneous"] == 1


def test_validators(spark):
    ddl = "name string, etag string, last_modified string, mtime int, size int"
    old = spark.createDataFrame([("a", "1", "m", 1, 1), ("b", None, "m", 1, 1), ("c", None, None, 1, 1), ("d", None, None, 1, 1), ("e", None, None, None, 1), ("f", "1", "m", 1, 1)], ddl)
    new = spark.createDataFrame([("a", "1", "n", 2, 2), ("b", "9", "m", 2, 2), ("c", None, None, 1, 1), ("d", None, None, 1, 2), ("e", None, None, None, 1), ("f", "2", "n", 2, 1), ("g", "1", "m", 1, 1)], ddl)
    assert rows(files_to_fetch(new, old).select("name"), "name") == [("d",), ("e",), ("f",), ("g",)]
    assert rows(files_to_fetch(new, old, ()).select("name"), "name") == [("c",), ("d",), ("e",), ("f",), ("g",)]


def test_failure_policy(spark, tmp_path):
    out = str(tmp_path / "out")
    missing = lambda: spark.read.parquet(str(tmp_path / "missing"))

    def malformed():
        raise SchemaError("no column")

    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        policy.refreshed(spark, missing, out)
    assert rows(policy.refreshed(spark, lambda: spark.range(2), out), "id") == [(0,), (1,)]
    assert rows(policy.refreshed(spark, lambda: spark.range(1), out), "id") == [(0,)]
    assert rows(policy.refreshed(spark, missing, out), "id") == [(0,)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        policy.refreshed(spark, missing, out, strict=True)
    with pytest.raises(SchemaError):
        policy.refreshed(spark, malformed, out)
    with pytest.raises(Exception, match="bad row"):
        policy.refreshed(spark, lambda: spark.range(1).select(F.raise_error(F.lit("bad row")).cast("long").alias("id")), out)
    assert rows(versions.current(spark, out), "id") == [(0,)]


def test_a_swap_killed_at_any_step(spark, tmp_path, monkeypatch):
    """After each step of a replacement that dies there, the old or the new table is there to read, and another run succeeds."""
    out = str(tmp_path / "t")
    versions.replace(spark.range(3), out)
    _, of = versions._fs(spark, out)
    steps = ["nothing", "data half written", "data written", "number claimed"]
    for n, step in enumerate(steps):
        if step == "data half written":
            (tmp_path / "t" / "versions" / "half").mkdir()
            (tmp_path / "t" / "versions" / "half" / "part-0.parquet").write_bytes(b"PAR1")
        if step in ("data written", "number claimed"):
            versions.stage(spark.range(99), out)
        if step == "number claimed":
            fs, of = versions._fs(spark, out)
            fs.createNewFile(of(f"{out}/claims/{versions.commits(spark, out)[-1][0] + 1:012d}"))
        assert versions.current(spark, out).count() == 3 + n
        assert versions.replace(versions.current(spark, out).unionByName(spark.range(1)), out).count() == 4 + n
    versions.vacuum(spark, out, 1)
    assert versions.current(spark, out).count() == 7 and len(list((tmp_path / "t" / "versions").iterdir())) == 1
    assert len(versions.commits(spark, out)) == 1


def test_two_writers(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "t")
    versions.replace(spark.range(1), out)
    a, b = versions.stage(spark.range(2), out), versions.stage(spark.range(3), out)
    seen = versions.commits(spark, out)
    versions.commit(spark, out, a)
    stale = iter([seen])
    real = versions.commits
    monkeypatch.setattr(versions, "commits", lambda s, p: next(stale, None) or real(s, p))
    with pytest.raises(FileExistsError):
        versions.commit(spark, out, b)  # which looked before the other's commit
    assert versions.current(spark, out).count() == 2


def test_annual_gap_and_tariff_end(spark):
    own = spark.createDataFrame([(1.0, 100.0, 40.0), (3.0, 50.0, 50.0), (9.0, None, 10.0)], "solar_mw double, tou_offset double, energy_price double")
    assert rows(value.annual_gap(own)) == [(2, None)]
    many = own.crossJoin(spark.range(24 * 365))
    ((hours, gap),) = rows(value.annual_gap(many))
    assert hours == 2 * 24 * 365 and gap == pytest.approx(60 / 250)
    assert rows(value.annual_gap(many.withColumn("solar_mw", F.lit(0.0)))) == [(hours, None)]
    plans = spark.createDataFrame([("TOU", "2026-10-31"), ("TOU", "2026-12-31"), ("ULO", "2026-10-31"), ("RPP", None), ("RPP", "2025-01-01")], "plan string, effective_to string")
    assert [(p, str(d)) for p, d in rows(tariff.ending(plans, "2026-10-15"), "plan")] == [("ULO", "2026-10-31")]
    assert rows(tariff.ending(plans, "2026-09-01"), "plan") == []
