"""Scheduled accumulation as a stream: new files in, keep-last merge out, and stop."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import winner
from ..sources import versions


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def accumulate(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], sequence: str, day: str, source_format: str = "parquet") -> StreamingQuery:
    """Merge all files of source that no earlier run has read into the table at target, partitioned by day.

    Of the rows of a key the last by (run, sequence) stays, on whatever day it was; a revised file comes again under a new
    name. A batch rewrites the days that its rows are on, or that rows of its keys were on before. What they will hold is
    staged first: a run that dies while it publishes is published again from there, and one that dies earlier has changed
    nothing. The file source's checkpoint is the manifest. No watermark: a merge that keeps the last needs no state.
    """

    def merged(batch: DataFrame) -> DataFrame:
        fresh = winner(batch, keys, F.col(sequence))
        old = _read(batch.sparkSession, target)
        if old is None:
            return fresh
        days = fresh.select(day)
        if day not in keys:  # days that rows of these keys leave
            days = days.unionByName(old.select(*keys, day).join(fresh.select(*keys), keys, "left_semi").select(day))
        touched = old.join(days.distinct(), day, "left_semi").withColumn("at_", F.lit(0))
        return winner(touched.unionByName(fresh.withColumn("at_", F.lit(1)), allowMissingColumns=True), keys, F.col("at_")).drop("at_")

    def publish(own: SparkSession, staged: str) -> None:
        rows = own.read.parquet(staged)
        left = own.read.parquet(f"{staged}.left")
        rows.repartition(F.col(day)).sortWithinPartitions(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(target)
        for r in left.toLocalIterator():  # days of which nothing is left
            versions.delete(own, r[0])

    def upsert(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        staged = f"{checkpoint}/staged/{number}"
        if not versions.exists(own, f"{staged}.left/_SUCCESS"):
            batch = batch.persist()
            try:
                merged(batch).write.mode("overwrite").parquet(staged)
                rows, old = own.read.parquet(staged), _read(own, target)
                if old is None or day in keys:
                    left = own.createDataFrame([], "folder string")
                else:
                    leaves = old.join(batch.select(*keys).distinct(), keys, "left_semi").join(rows.select(day).distinct(), day, "left_anti")
                    folder = F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1)
                    left = old.select(day, folder.alias("folder")).join(leaves.select(day).distinct(), day, "left_semi").select("folder").distinct()
                left.write.mode("overwrite").parquet(f"{staged}.left")
            finally:
                batch.unpersist()
        publish(own, staged)
        for done in (f"{checkpoint}/staged/{number - 1}", f"{checkpoint}/staged/{number - 1}.left"):
            versions.delete(own, done)

    stream = spark.readStream.format(source_format).schema(schema).load(source)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_stream(hourly: DataFrame, time: str = "timestamp_utc", late: str = "2 days") -> DataFrame:
    """An extension: daily sums per node of a stream of matched hours, given out once a day can't change any more."""
    return hourly.withWatermark(time, late).groupBy("node_id", F.window(time, "1 day")).agg(F.sum("premium").alias("sum_premium"), F.count("*").alias("n_hours"))
