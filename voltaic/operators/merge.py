"""Keyed merges and choices: keep-last, one winner per key, the latest file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_version


def winner(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the one with the greatest order (nulls are least). An aggregation, so nothing is sorted and keys combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("best_")
    return df.groupBy(*keys).agg(best).select(*keys, "best_.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], *sequence: str) -> DataFrame:
    """One row per key, the last by the sequence columns. sequence must order the rows of a key: (run, file, row), say."""
    return winner(df, keys, *[F.col(c) for c in sequence])


def merge(old: DataFrame, new: DataFrame, keys: list[str], *sequence: str, since: Column | None = None) -> DataFrame:
    """old with new's rows in place of those of their keys; columns of either; rows before since (on the result) dropped.

    What new has twice for a key is settled by sequence, which old needn't have; key columns come first, others by name.
    """
    run = "merge_run_"
    both = old.withColumn(run, F.lit(0)).unionByName(keep_last(new, keys, *sequence).withColumn(run, F.lit(1)), allowMissingColumns=True)
    out = winner(both, keys, F.col(run)).drop(run)
    out = out.select(*keys, *sorted(c for c in out.columns if c not in keys))
    return out if since is None else out.where(since)


def winner_per_date(files: DataFrame, name: str = "name") -> DataFrame:
    """date, name: of the files of one date the final one, else the highest version; of equals the first by name."""
    date, final, version = file_version(F.col(name))
    ranked = files.select(date.alias("date"), final.alias("final_"), version.alias("version_"), F.col(name)).where("date is not null")
    best = ranked.groupBy("date", "final_", "version_").agg(F.min(name).alias(name))
    return winner(best, ["date"], F.col("final_"), F.col("version_")).select("date", name)


def latest_file(files: DataFrame, name: str = "name") -> DataFrame:
    """The file to read of a feed: the one without a date, else the newest date's winner."""
    date, final, version = file_version(F.col(name))
    return files.select(name).groupBy().agg(F.max_by(name, F.struct(date.isNull().alias("a"), F.coalesce(date, F.lit("")).alias("b"), final.alias("c"), version.alias("d"), F.col(name).alias("e"))).alias(name))


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or whose time or size changed since the manifest(name, mtime, size)."""
    same = ["name", "mtime", "size"]
    return listing.join(manifest.select(*same).distinct(), same, "left_anti")


def files_to_fetch(seen: DataFrame, manifest: DataFrame, weak: tuple[str, ...] = ("mtime", "size")) -> DataFrame:
    """Rows of seen(name, etag, last_modified and the weak validators) that the manifest doesn't show as unchanged.

    A file is unchanged if its ETag, else its Last-Modified, else all of its weak validators are known and as before. A
    validator that one side doesn't have decides nothing.
    """
    own = manifest.select("name", *[F.col(c).alias(f"old_{c}") for c in ("etag", "last_modified", *weak)])
    same = lambda c: F.coalesce(F.col(c) == F.col(f"old_{c}"), F.lit(False))
    unchanged = same("etag") | same("last_modified")
    if weak:
        every = F.lit(True)
        for c in weak:
            every &= same(c)
        unchanged |= every
    return seen.join(own, "name", "left").where(~unchanged).select(*seen.columns)
