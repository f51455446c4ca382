"""Records in files by format, for the manifest: CSV by quote state over all splits, XML and XLSX by streaming over elements."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a line may start: outside quotes; within quotes of a record blank so far; within quotes of one that isn't.
OUT, BLANK, FULL = 0, 1, 2
#: The sheet that holds a workbook's records, and the child of a document's body that is no record.
SHEET, NO_RECORD = "Contract Data", "DeliveryDate"


def _name() -> Column:
    return F.regexp_extract("path", "([^/]+)$", 1).alias("name")


def line_state(line: str, start: int) -> tuple[int, bool, int]:
    """How the next line starts, whether the record has content by then, and the commas outside quotes, as a serial CSV reader would see the line.

    A quote opens a quoted field at the field's start only, and within it two quotes are one.
    """
    quoted, content, commas, fresh, i = start != OUT, start == FULL, 0, start == OUT, 0
    while i < len(line):
        c = line[i]
        if quoted:
            if c == '"' and line[i + 1 : i + 2] == '"':
                content, i = True, i + 1
            elif c == '"':
                quoted = False
            else:
                content |= not c.isspace()
        elif c == ",":
            commas, fresh = commas + 1, True
            i += 1
            continue
        elif c == '"' and fresh:
            quoted = True
        else:
            content |= not c.isspace()
        fresh = False
        i += 1
    return (FULL if content else BLANK) if quoted else OUT, content, commas


SPLIT = "path string, start long, state int, n long, open boolean, ends int, first array<int>"


def _split_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split and each way it may start: records with content that end in it, how the next split starts, and the fields of its first two records."""
    now: tuple | None = None
    states: list[list] = []

    def out() -> pa.RecordBatch:
        cols = list(zip(*[(now[0], now[1], start, n, state != OUT, state, first[:2]) for start, (state, n, fields, first) in enumerate(states)]))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["path", "start", "state", "n", "open", "ends", "first"])

    for batch in batches:
        for path, start, line, content, commas in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "line", "content", "commas"))):
            if now != (path, start):
                if now:
                    yield out()
                now, states = (path, start), [[s, 0, 1, []] for s in (OUT, BLANK, FULL)]
            for own in states:
                if line is not None:
                    ends, full, more = line_state(line, own[0])
                elif own[0] == OUT:
                    ends, full, more = OUT, content, commas
                else:  # a line without quotes within a quoted field
                    full, more = own[0] == FULL or content or commas > 0, 0
                    ends = FULL if full else BLANK
                own[2] += more
                if ends == OUT:
                    if full:
                        own[1] += 1
                        if len(own[3]) < 2:
                            own[3].append(own[2])
                    own[2] = 1
                own[0] = ends
    if now:
        yield out()


def csv_records(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """path, name, n_rows of CSV files: records with any content, less the header, and less a first line of fewer fields than the second.

    Files are read in splits by any number of tasks. A split doesn't know whether it starts within quotes, so each gives
    what it would count either way; the splits of a file, a row each, are then put in order.
    """
    lines = spark.read.options(**options).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.regexp_replace("value", "^﻿", "").alias("text"))
    narrow = lines.select("path", "start", F.when(F.contains("text", F.lit('"')), F.col("text")).alias("line"), F.rlike("text", F.lit(r"[^,\s]")).alias("content"), F.regexp_count("text", F.lit(",")).alias("commas"))

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        state, total, first = OUT, 0, []
        for _, own in group.sort_values("start").groupby("start", sort=False):
            r = own[own["state"] == state].iloc[0]
            total, first, state = total + int(r["n"]), [*first, *r["first"]], int(r["ends"])
        total += state == FULL  # a record that the file's end cuts off
        skip = len(first) > 1 and first[0] < first[1]
        return pd.DataFrame({"path": [group["path"].iloc[0]], "n_rows": [max(0, total - skip - 1)]})

    counted = narrow.mapInArrow(_split_states, SPLIT).groupBy("path").applyInPandas(compose, "path string, n_rows long")
    return counted.select("path", _name(), "n_rows")


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def xml_records(content: bytes) -> int:
    """Elements right under the body of a document, but for its date; right under the root, if it has no body."""
    depth, body, under_root, under_body = 0, False, 0, 0
    for event, element in ElementTree.iterparse(io.BytesIO(content), events=("start", "end")):
        if event == "start":
            depth += 1
            body |= depth == 2 and _tag(element) == "DocBody"
            continue
        depth -= 1
        if depth == 1:
            under_root += 1
            element.clear()
        elif depth == 2 and body:
            under_body += _tag(element) != NO_RECORD
            element.clear()
    return under_body if body else under_root


def _sheet_rows(sheet) -> int:
    """Rows with any value of a worksheet that is read as it streams in."""
    n = 0
    for _, element in ElementTree.iterparse(sheet):
        if _tag(element) == "row":
            n += any((x.text or "") != "" for x in element.iter() if _tag(x) in ("v", "t"))
            element.clear()
    return n


def xlsx_records(content: bytes) -> int:
    """Rows with any value of the sheet that holds the records, else of the largest sheet."""
    from .readers import sheet_members

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        sheets = sheet_members(z)
        chosen = [sheets[SHEET]] if SHEET in sheets else list(sheets.values())
        sizes = []
        for member in chosen:
            with z.open(member) as sheet:
                sizes.append(_sheet_rows(sheet))
    return max(sizes, default=0)


def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, n_rows of a folder's CSV, XML and XLSX files, in folders below it too; null where a file can't be read, as counting must not break a run."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("_metadata.file_path").alias("path"), "content")
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    tables = files.select("path").where(ending.isin("csv", "xml", "xlsx"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    out.append((xlsx_records if path.lower().endswith(".xlsx") else xml_records)(content))
                except (ElementTree.ParseError, zipfile.BadZipFile, KeyError, ValueError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.int64())], ["path", "n_rows"])

    counted = files.where(ending.isin("xml", "xlsx")).mapInArrow(count, "path string, n_rows long")
    if not tables.where(ending == "csv").isEmpty():
        counted = counted.unionByName(csv_records(spark, folder, recursiveFileLookup="true", pathGlobFilter="*.[cC][sS][vV]").drop("name"))
    return tables.join(counted, "path", "left").select("path", _name(), "n_rows")
