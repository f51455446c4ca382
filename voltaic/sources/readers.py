"""Readers: CSV, XML, GeoJSON, KMZ and XLSX to typed tables; what doesn't fit its schema fails."""

from __future__ import annotations

import io
import logging
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.time import hour_ending_utc
from ..schemas import SchemaError, require

_LOG = logging.getLogger(__name__)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header that must be the schema's; select() of it reads the columns it needs."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False, multiLine=True)


def zonal_prices(spark: SparkSession, path: str) -> DataFrame:
    """timestamp_utc, price from day-ahead zonal XML; hours without a price are left out."""
    hour = "struct<PricingHour:string,ZonalPrice:string>"
    doc = spark.read.format("xml").option("rowTag", "DocBody").schema(f"DeliveryDate string, HourlyPriceComponents array<{hour}>").load(path)
    rows = doc.select(F.trim("DeliveryDate").alias("day"), F.explode("HourlyPriceComponents").alias("h"))
    price = F.nullif(F.trim("h.ZonalPrice"), F.lit("")).cast("double")
    return rows.select(hour_ending_utc(F.col("day"), F.trim("h.PricingHour")).alias("timestamp_utc"), price.alias("price")).where("price is not null")


def fuel_mix(spark: SparkSession, path: str, fuels: list[str] | None = None) -> DataFrame:
    """timestamp_utc and MW per fuel from output XML; rows without output and the control_actions pseudo fuel are left out.

    fuels: the columns, if known; else one pass finds them.
    """
    fuel = "struct<Fuel:string,EnergyValue:struct<Output:string>>"
    hour = f"struct<Hour:string,FuelTotal:array<{fuel}>>"
    doc = spark.read.format("xml").option("rowTag", "DailyData").schema(f"Day string, HourlyData array<{hour}>").load(path)
    hours = doc.where("Day is not null").select(F.trim("Day").alias("day"), F.explode("HourlyData").alias("h")).where("h.Hour is not null")
    rows = hours.select(hour_ending_utc(F.col("day"), F.trim("h.Hour")).alias("timestamp_utc"), F.explode("h.FuelTotal").alias("f"))
    name = F.regexp_replace(F.lower(F.trim("f.Fuel")), " ", "_")
    rows = rows.select("timestamp_utc", name.alias("fuel"), F.nullif(F.trim("f.EnergyValue.Output"), F.lit("")).cast("double").alias("mw")).where("fuel <> 'control_actions' and mw is not null")
    return rows.groupBy("timestamp_utc").pivot("fuel", fuels).agg(F.last("mw"))


def _numbered(spark: SparkSession, path: str, n_heads: int) -> tuple[DataFrame, DataFrame]:
    """The lines of text files: lines(file, block, id, line), and blocks(file, block, skip, heads) to join to them.

    Files are read in portions, so no task holds a whole one. id - skip is a line's number in its file, from 0; heads are
    the file's first n_heads lines. Blocks are a row for each portion of a file, as many as the driver lists anyway.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line"))
    # A portion's ids follow each other, so its first lines differ in the remainder by their number.
    heads = [F.min(F.when(F.col("id") % n_heads == i, F.struct("block", "id", "line"))) for i in range(n_heads)]
    found = lines.groupBy("file", "block").agg(F.count("*").alias("many"), F.min("id").alias("first"), F.array_compact(F.array(*heads)).alias("heads"))
    before = F.sum("many").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    first = found.groupBy("file").agg(F.slice(F.array_sort(F.flatten(F.collect_list("heads"))), 1, n_heads)["line"].alias("heads"))
    blocks = found.select("file", "block", (F.col("first") - F.coalesce(before, F.lit(0))).alias("skip")).join(first, "file")
    return lines, blocks


def _rate_rows(spark: SparkSession, path: str) -> DataFrame:
    """Each data row of hourly rate CSVs: file, row, day, he, rate, text of the rate, status. A file without a rate column fails.

    Files are read as lines so that each one's own header names its columns; commas and quotes within quotes are kept.
    """
    lines, blocks = _numbered(spark, path, 1)

    def cells(line: Column) -> Column:
        # A field is quoted, with quotes doubled within, or has no comma; each ends at a comma or the line's end.
        fields = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'\s*("(?:[^"]|"")*"[^,]*|[^,]*),'), F.lit(1))
        return F.transform(fields, lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"(?=[^"]*$)', ""), '""', '"')))

    head = cells(F.regexp_replace(F.get("heads", F.lit(0)), "^\ufeff", ""))
    rate_at = F.array_position(F.transform(head, lambda c: F.contains(c, F.lit("Rate ($/MWh)"))), True)
    checked = F.when(rate_at > 0, rate_at).otherwise(F.raise_error(F.concat(F.lit("no rate column: "), F.col("file"))).cast("long"))
    blocks = blocks.select("file", "block", "skip", head.alias("head"), checked.alias("rate_at"))
    rows = lines.join(F.broadcast(blocks), ["file", "block"]).withColumn("row", F.col("id") - F.col("skip") - 1).where("row >= 0 and trim(line) <> ''")
    rows = rows.withColumn("cells", cells(F.col("line")))

    def cell(name: str):
        return F.get("cells", F.array_position("head", name) - 1)

    he = F.try_to_number(cell("Hour"), F.lit("99")).cast("int")
    text = F.coalesce(F.get("cells", F.col("rate_at") - 1), F.lit(""))
    return rows.select("file", "row", cell("Date").alias("date"), cell("Hour").alias("hour"), F.try_to_date(cell("Date")).alias("day"), F.when(he.between(1, 25), he).alias("he"), text.try_cast("double").alias("rate"), text.alias("text"), cell("Status").alias("status"))


def adjustment_rates(spark: SparkSession, path: str) -> DataFrame:
    """timestamp_utc, rate, status, file, row from hourly rate CSVs whose rate column's name varies; blank and unreadable rows are left out (see blank_rates)."""
    rows = _rate_rows(spark, path).where("day is not null and he is not null and rate is not null")
    return rows.select(hour_ending_utc(F.col("day"), F.col("he")).alias("timestamp_utc"), "rate", "status", "file", "row")


def blank_rates(spark: SparkSession, path: str) -> DataFrame:
    """file, n_blank: rows with a date and an hour but no rate, of files that have any; for the log."""
    rows = _rate_rows(spark, path).where("coalesce(date, '') <> '' and coalesce(hour, '') <> '' and text = ''")
    return rows.groupBy("file").agg(F.count("*").alias("n_blank"))


def nodal_prices(spark: SparkSession, path: str) -> DataFrame:
    """node_id, date, timestamp_utc, lmp, loss, congestion from daily CSVs whose first line has the delivery date."""
    lines, blocks = _numbered(spark, path, 2)
    stamp = F.regexp_extract(F.get("heads", F.lit(0)), r"FOR (\d{4}/\d{2}/\d{2})", 1)
    day = F.when(stamp != "", F.to_date(stamp, "yyyy/MM/dd")).otherwise(F.raise_error(F.concat(F.lit("no delivery date: "), F.col("file"))).cast("date"))
    head = F.transform(F.split(F.get("heads", F.lit(1)), ","), lambda c: F.trim(c))
    blocks = blocks.select("file", "block", "skip", day.alias("date"), head.alias("head"))
    rows = lines.join(F.broadcast(blocks), ["file", "block"]).where("id - skip >= 2 and trim(line) <> ''")
    rows = rows.withColumn("cells", F.transform(F.split("line", ",", -1), lambda c: F.trim(c)))

    def cell(name: str):
        return F.nullif(F.get("cells", F.array_position("head", name) - 1), F.lit(""))

    return rows.select(
        cell("Pricing Location").alias("node_id"), "date", hour_ending_utc(F.col("date"), cell("Delivery Hour")).alias("timestamp_utc"),
        cell("LMP").cast("double").alias("lmp"), cell("Energy Loss Price").cast("double").alias("loss"), cell("Energy Congestion Price").cast("double").alias("congestion"),
    )


def regulator_table(spark: SparkSession, path: str, tag: str, columns: list[str]) -> DataFrame:
    """A flat XML table as text columns. Elements that are zero are left out of records, so columns are those of all rows together."""
    table = spark.read.format("xml").option("rowTag", tag).option("inferSchema", False).load(path)
    if not table.columns or table.isEmpty():
        raise SchemaError(f"{path}: no records")
    return require(table, columns, path)


def _names_in(content: bytes) -> list[tuple[str, str | None]]:
    """Current and former names of a regulator table's records, whatever their tag."""
    out = []
    for record in ElementTree.fromstring(content):
        own = {c.tag.rpartition("}")[2]: (c.text or "").strip() for c in record}
        if name := own.get("Current_Company_Name"):
            out.append((name, own.get("Historical_Company_Name") or None))
    return sorted(set(out), key=lambda x: (x[0], x[1] or ""))


def regulator_names(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """current(name) and historical(former, name) of the tables that a glob names; of a former name's companies the first by file.

    No file gives empty tables and a warning, as the tables may come later.
    """
    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        _LOG.warning("no regulator tables at %s: no names", path)
        empty = spark.createDataFrame([], "name string, former string")
        return empty.select("name"), empty.select("former", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                names = _names_in(content)
                yield pa.RecordBatch.from_arrays([pa.array([file.rpartition("/")[2]] * len(names), pa.string()), *(pa.array([n[i] for n in names], pa.string()) for i in (0, 1))], ["table", "name", "former"])

    rows = files.select("path", "content").mapInArrow(run, "table string, name string, former string")
    former = rows.where("former is not null").groupBy("former").agg(F.min(F.struct("table", "name")).alias("first"))
    return rows.select("name").distinct(), former.select("former", "first.name")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Feature properties and geometry as POLYGONS, from a FeatureCollection of Polygons and MultiPolygons."""
    schema_of = spark.read.json(path, multiLine=True).schema
    if "features" not in schema_of.names:
        raise SchemaError(f"{path}: no features")
    props = schema_of["features"].dataType.elementType["properties"].dataType.names
    raw = spark.read.text(path, wholetext=True)
    kind = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
    f = raw.select(F.explode(F.from_json("value", kind)["features"]).alias("f"))
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    one = F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    shapes = F.when(F.col("f.geometry.type") == "MultiPolygon", many).when(F.col("f.geometry.type") == "Polygon", one)

    def point(p):
        return F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))

    polygons = F.transform(shapes, lambda s: F.transform(s, lambda r: F.transform(r, point)))
    return f.select(*[F.get(F.array(F.col("f.properties")[p]), F.lit(0)).alias(p) for p in props], polygons.alias("geometry"))


def sheet_cells(sheet, strings: list[str]) -> Iterator[list]:
    """The rows of a worksheet, a file that is read as it streams in, as lists of text."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    for _, row in ElementTree.iterparse(sheet):
        if row.tag != f"{main}row":
            continue
        out: list = []
        for c in row.iter(f"{main}c"):
            letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
            at = 0
            for x in letters:
                at = at * 26 + ord(x) - 64
            out += [None] * (max(at, len(out) + 1) - len(out))
            v, text = c.find(f"{main}v"), "".join(t.text or "" for t in c.iter(f"{main}t"))
            value = text or None if v is None or v.text is None else strings[int(v.text)] if c.get("t") == "s" else v.text
            out[(at or len(out)) - 1] = value
        row.clear()
        yield out


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    """The texts that a workbook's cells refer to by number."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]


def sheet_members(z: zipfile.ZipFile) -> dict[str, str]:
    """The archive's member of each sheet of a workbook, in order."""
    main, rel = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    found = {s.get("name"): targets[s.get(f"{rel}id")] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")}
    return {name: t.lstrip("/") if t.startswith("/") else f"xl/{t}" for name, t in found.items()}


def xlsx_rows(content: bytes, sheet: str, header_row: int) -> list[dict]:
    """The rows of a sheet as dicts of text, by the header in header_row (from 1)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        members = sheet_members(z)
        if sheet not in members:
            raise SchemaError(f"no sheet {sheet}")
        with z.open(members[sheet]) as member:
            rows = list(sheet_cells(member, shared_strings(z)))
    names = rows[header_row - 1]
    return [{n: (r[i] if i < len(r) else None) for i, n in enumerate(names) if n} for r in rows[header_row:] if any(x is not None for x in r)]


def xlsx(spark: SparkSession, path: str, sheet: str, columns: list[str], header_row: int = 3) -> DataFrame:
    """Text columns of a workbook's sheet; each file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = xlsx_rows(content, sheet, header_row)
                if rows and (missing := [c for c in columns if c not in rows[0]]):
                    raise SchemaError(f"missing columns {missing}")
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], pa.string()) for c in columns], columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


def _attribute(description: str, name: str) -> str | None:
    found = re.search(rf"<td[^>]*>\s*{re.escape(name)}\s*</td>\s*<td[^>]*>(.*?)</td>", description, re.S | re.I)
    return unescape(re.sub("<[^>]*>", "", found[1])).strip() or None if found else None


def kml_placemarks(content: bytes, fields: list[str]) -> list[dict]:
    """name, fields from each placemark's HTML table, and geometry with holes."""
    root = ElementTree.fromstring(content)
    ns = root.tag.partition("}")[0] + "}" if root.tag.startswith("{") else ""

    def ring(node) -> list[dict]:
        points = (x.split(",") for x in (node.findtext(f".//{ns}coordinates") or "").split())
        return [{"x": float(p[0]), "y": float(p[1])} for p in points]

    out = []
    for mark in root.iter(f"{ns}Placemark"):
        text = mark.findtext(f"{ns}description") or ""
        shapes = []
        for p in mark.iter(f"{ns}Polygon"):
            shell = p.find(f"{ns}outerBoundaryIs")
            if shell is not None:
                shapes.append([ring(shell), *[ring(h) for h in p.findall(f"{ns}innerBoundaryIs")]])
        if shapes:
            out.append({"name": mark.findtext(f"{ns}name"), **{f: _attribute(text, f) for f in fields}, "geometry": shapes})
    return out


def kmz(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Placemarks of zipped KML files, and of those inside ZIPs (their first .kmz)."""
    shape = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    inner = next((n for n in z.namelist() if n.lower().endswith(".kmz")), None)
                    if inner:
                        content = z.read(inner)
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = [r for n in z.namelist() if n.lower().endswith(".kml") for r in kml_placemarks(z.read(n), fields)]
                cols = [pa.array([r[c] for r in rows], pa.string()) for c in ("name", *fields)] + [pa.array([r["geometry"] for r in rows], shape)]
                yield pa.RecordBatch.from_arrays(cols, ["name", *fields, "geometry"])

    ddl = ", ".join(f"`{c}` string" for c in ("name", *fields)) + ", geometry array<array<array<struct<x:double,y:double>>>>"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ddl)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """name, mtime, size, sha256 of a folder's files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def index_links(html: DataFrame, prefix: str) -> DataFrame:
    """name of each link in directory pages(html) that starts with the prefix."""
    links = F.regexp_extract_all("html", F.lit(r'href="([^"/]+)"'), 1)
    return html.select(F.explode(links).alias("name")).where(F.startswith("name", F.lit(prefix))).distinct()


def newest_datasets(links: DataFrame) -> DataFrame:
    """dataset, url: of links(dataset, vintage, name, url) the newest vintage's, names that start with "ED " first."""
    from ..operators.merge import winner

    return winner(links, ["dataset"], F.col("vintage"), F.startswith("name", F.lit("ED ")), F.col("url")).select("dataset", "url")


