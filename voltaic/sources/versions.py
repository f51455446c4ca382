"""Tables that are replaced as a whole: each version is a folder of its own, and a commit names the one that holds.

A version is written under <path>/versions/<id>; the table changes at the moment when <path>/commits/<number>-<id> comes to
be, which a file system makes in one step or not at all. Whatever a writer that died has left, readers see the last commit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Digits of a commit's number, so that names are in order.
DIGITS = 12


def _fs(spark: SparkSession, path: str):
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def exists(spark: SparkSession, path: str) -> bool:
    fs, of = _fs(spark, path)
    return fs.exists(of(path))


def delete(spark: SparkSession, path: str) -> None:
    fs, of = _fs(spark, path)
    fs.delete(of(path), True)


def commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and version of the table's commits, in order; a table has a few (see vacuum)."""
    folder = f"{path.rstrip('/')}/commits"
    fs, of = _fs(spark, folder)
    if not fs.exists(of(folder)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(of(folder))]
    return sorted((int(n), v) for n, _, v in (x.partition("-") for x in names) if n.isdigit() and len(n) == DIGITS and v)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its last commit; a plain folder of Parquet, if nothing has been committed."""
    path = path.rstrip("/")
    done = commits(spark, path)
    return spark.read.parquet(f"{path}/versions/{done[-1][1]}" if done else path)


def stage(df: DataFrame, path: str) -> str:
    """Write df as a new version, which nobody sees before commit(); gives its id."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{path.rstrip('/')}/versions/{version}")
    return version


def commit(spark: SparkSession, path: str, version: str) -> None:
    """Make the version the table's. Of two writers with the same number one fails and changes nothing: FileExistsError."""
    path = path.rstrip("/")
    number = max((n for n, _ in commits(spark, path)), default=0) + 1
    claim = f"{path}/claims/{number:0{DIGITS}d}"
    fs, of = _fs(spark, path)
    fs.mkdirs(of(f"{path}/commits"))
    # The claim settles who has the number; the commit's name then says all there is to say, so it needs no content.
    if not fs.createNewFile(of(claim)) and any(n == number for n, _ in commits(spark, path)):
        raise FileExistsError(f"{path}: commit {number} is another's")
    fs.createNewFile(of(f"{path}/commits/{number:0{DIGITS}d}-{version}"))


def replace(df: DataFrame, path: str) -> DataFrame:
    """The table at path with df's rows alone, df may read the table itself."""
    spark = df.sparkSession
    commit(spark, path, stage(df, path))
    return current(spark, path)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete versions and commits but the last `keep`: call it when no reader of an older one and no writer is at work."""
    path = path.rstrip("/")
    done = commits(spark, path)
    kept = {v for _, v in done[-keep:]}
    fs, of = _fs(spark, path)
    for n, v in done[:-keep]:
        fs.delete(of(f"{path}/commits/{n:0{DIGITS}d}-{v}"), False)
    if fs.exists(of(f"{path}/versions")):
        for f in fs.listStatus(of(f"{path}/versions")):
            if f.getPath().getName() not in kept:
                fs.delete(f.getPath(), True)
