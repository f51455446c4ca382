"""Workbooks and zipped maps as data sources: a partition for each sheet or member of each archive of a folder.

    archives.register(spark)
    spark.read.format("voltaic_xlsx").schema("Fuel string, MW string, sheet string").option("header", 3).load(folder)
    spark.read.format("voltaic_kmz").option("fields", "Licence,Name").load(folder)

Only archives' directories are read to plan; members are read by tasks, as they stream in, and only the schema's columns are
kept. Filters on file and sheet (or member) choose partitions. Paths are local or those that Arrow's file systems know.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..schemas import POLYGONS, SchemaError
from .readers import kml_placemarks, sheet_cells, sheet_members, shared_strings

#: Rows of a batch that a task gives out.
ROWS = 4096


@dataclass
class Member(InputPartition):
    """A member of an archive; inner: the archive within the archive that it is in; label: what filters call it."""

    file: str
    member: str
    label: str
    inner: str | None = None


def _system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def files_of(path: str, *endings: str) -> list[str]:
    """The files at or below path with one of the endings, as URIs or paths like it, in order of name."""
    system, plain = _system(path)
    info = system.get_file_info(plain)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == arrow_fs.FileType.File else system.get_file_info(arrow_fs.FileSelector(plain, recursive=True))
    scheme = path[: path.index(plain)] if plain in path and path != plain else ""
    return sorted(scheme + f.path for f in found if f.type == arrow_fs.FileType.File and f.path.lower().endswith(endings))


def _opened(file: str, inner: str | None = None) -> zipfile.ZipFile:
    system, plain = _system(file)
    z = zipfile.ZipFile(system.open_input_file(plain))
    return zipfile.ZipFile(io.BytesIO(z.read(inner))) if inner else z


class _Reader(DataSourceReader):
    """Partitions chosen by filters on the file's name and on the column `label`."""

    label: str

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.only = schema, dict(options), {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in ("file", self.label):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[name] = self.only.get(name, values) & values
            else:
                yield f

    def members(self) -> Iterator[Member]:
        raise NotImplementedError

    def partitions(self) -> list[Member]:
        own = [m for m in self.members() if m.file.rpartition("/")[2] in self.only.get("file", {m.file.rpartition("/")[2]}) and m.label in self.only.get(self.label, {m.label})]
        return own or [Member("", "", "")]  # Spark asks for one at least

    def rows(self, part: Member) -> Iterator[dict]:
        raise NotImplementedError

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        kind = pa.schema([pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in self.schema])
        fixed = {"file": partition.file.rpartition("/")[2], self.label: partition.label}
        held: list[dict] = []
        for row in self.rows(partition):
            held.append({name: fixed.get(name, row.get(name)) for name in kind.names})
            if len(held) == ROWS:
                yield pa.RecordBatch.from_pylist(held, kind)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kind)


_ARROW = {"string": pa.string(), POLYGONS: pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))}


class _SheetReader(_Reader):
    label = "sheet"

    def members(self) -> Iterator[Member]:
        wanted = self.options.get("sheet")
        for file in files_of(self.options["path"], ".xlsx"):
            with _opened(file) as z:
                for name, member in sheet_members(z).items():
                    if wanted in (None, name):
                        yield Member(file, member, name)

    def rows(self, part: Member) -> Iterator[dict]:
        header_row = int(self.options.get("header", 1))
        needed = [f.name for f in self.schema if f.name not in ("file", "sheet")]
        with _opened(part.file) as z:
            strings = shared_strings(z)
            names: list | None = None
            with z.open(part.member) as sheet:
                for n, cells in enumerate(sheet_cells(sheet, strings), 1):
                    if n == header_row:
                        names = cells
                        if missing := [c for c in needed if c not in names]:
                            raise SchemaError(f"{part.file}, {part.label}: missing columns {missing}")
                        at = {c: names.index(c) for c in needed}
                    elif n > header_row and any(x is not None for x in cells):
                        yield {c: cells[i] if i < len(cells) else None for c, i in at.items()}


class _MapReader(_Reader):
    label = "member"

    def members(self) -> Iterator[Member]:
        for file in files_of(self.options["path"], ".kmz", ".zip"):
            with _opened(file) as z:
                names = z.namelist()
            inner = sorted(n for n in names if n.lower().endswith(".kmz"))
            for archive in inner or [None]:
                if archive:
                    with _opened(file, archive) as z:
                        names = z.namelist()
                for name in names:
                    if name.lower().endswith(".kml"):
                        yield Member(file, name, name, archive)

    def rows(self, part: Member) -> Iterator[dict]:
        fields = [f.name for f in self.schema if f.name not in ("file", "member", "name", "geometry")]
        with _opened(part.file, part.inner) as z:
            yield from kml_placemarks(z.read(part.member), fields)


class SheetSource(DataSource):
    """Text columns of workbooks' sheets, by the header in row `header` (from 1); file and sheet tell where a row is from. The schema has to be given."""

    @classmethod
    def name(cls) -> str:
        return "voltaic_xlsx"

    def schema(self) -> str:
        raise SchemaError("voltaic_xlsx needs a schema: the columns to read")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SheetReader(schema, self.options)


class MapSource(DataSource):
    """Placemarks of zipped maps, and of maps within archives: name, the fields of their tables, geometry, file, member."""

    @classmethod
    def name(cls) -> str:
        return "voltaic_kmz"

    def schema(self) -> str:
        fields = [f.strip() for f in self.options.get("fields", "").split(",") if f.strip()]
        return ", ".join([*(f"`{c}` string" for c in ("name", *fields)), f"geometry {POLYGONS}", "file string", "member string"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _MapReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SheetSource, MapSource):
        spark.dataSource.register(source)


def retain(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """file, name, kept: the first map within each archive at path, copied untouched into folder under its own name; one that is there already stays (kept is false).

    Each archive is copied by one task, to a name of its own first, so a copy is whole or not there.
    """
    files = spark.createDataFrame([(f,) for f in files_of(path, ".zip")], "file string")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, target = _system(folder)
        for batch in batches:
            rows = []
            for file in batch.column("file").to_pylist():
                with _opened(file) as z:
                    inner = next((n for n in z.namelist() if n.lower().endswith(".kmz")), None)
                    if inner is None:
                        continue
                    name = inner.rpartition("/")[2]
                    new = system.get_file_info(f"{target}/{name}").type == arrow_fs.FileType.NotFound
                    if new:
                        system.create_dir(target, recursive=True)
                        part = f"{target}/.{name}.{file.rpartition('/')[2]}.part"
                        with z.open(inner) as source, system.open_output_stream(part) as out:
                            while chunk := source.read(1 << 20):
                                out.write(chunk)
                        system.move(part, f"{target}/{name}")
                    rows.append({"file": file, "name": name, "kept": new})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("name", pa.string()), ("kept", pa.bool_())]))

    return files.repartition("file").mapInArrow(copy, "file string, name string, kept boolean")

