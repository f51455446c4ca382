"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_folder

#: The white space of the word patterns, as a regular expression class of what is not white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors see."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_folder(spark))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: later steps read it instead of doing df's work again, whatever executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 64) -> Iterator[None]:
    """While this lasts, actions send so many rows at once to Python workers: for rows of long texts or sets, whose batches must fit in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """While this lasts, the shuffle files of an action are deleted when it ends: for steps whose results are durable, so that no step's files stand beside the next one's."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df marked for broadcast if it has `most` rows or fewer, else as it is: joins with it shuffle then. Rows must be short, df cheap to read."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names, whatever their case; results take their place."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths laid end to end: each element's run, and its place in the run."""
    lengths = np.asarray(lengths, np.int64)
    run = np.repeat(np.arange(len(lengths)), lengths)
    start = np.cumsum(lengths) - lengths
    return run, np.arange(len(run)) - start[run]


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as UTF-8 bytes; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def _give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library only
        trim(0)


#: By module: how to drop what its functions keep in this process from task to task.
_kept: dict[str, Callable[[], object]] = {}


def keep(module: str, forget: Callable[[], object]) -> None:
    """module keeps something in this process for its next task; forget drops it when a task of another module begins here."""
    _kept[module] = forget


def _begin(module: str) -> None:
    """What other modules keep here goes: it would stand beside all that this one's tasks hold."""
    if others := _kept.keys() - {module}:
        for other in others:
            _kept.pop(other)()
        _give_back()


def lean(run: Callable) -> Callable:
    """run, a function of batches for mapInArrow, whose worker holds no freed memory when its task has ended, and nothing of other modules' tasks.

    Workers outlive their tasks, and those of earlier steps stand beside those of later ones.
    """
    module = run.__module__

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(module)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return of


def lean_group(run: Callable) -> Callable:
    """run, a function of a group's table for applyInArrow, whose worker holds no freed memory after it, and nothing of other modules' tasks."""
    module = run.__module__

    def of(table: pa.Table) -> pa.Table:
        _begin(module)
        try:
            return run(table)
        finally:
            _give_back()

    return of


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def extended(df: DataFrame, ddl: str) -> StructType:
    """df's schema with further columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
