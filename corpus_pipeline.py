"""A training corpus from documents: language ID, near-dedup, substring dedup, source mixing, tokens.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next one's
docs; all but the last have the columns of documents. run() gives the last one's rows. SQL can't express the stages;
tests/llm holds them against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltaic.llm import bpe, cube_mixing, language_id, near_copies, suffix_dedup
from voltaic.llm.common import shared_folder
from voltaic.sources import versions

#: A document goes if less than this share of its letters is in one language.
LEAST_SHARE = 0.5
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, learned from all labelled ones, that holds LEAST_SHARE of their letters; letterless ones go.

    So null and empty texts go; rows with null lang are not learned from; repeated rows and null doc_ids are judged as
    others are, long texts whole; columns whose names clash with the operator's are set aside and put back.
    """
    model = language_id.train(docs.select("text", "lang"))
    names = {c: f"keep_{i}" for i, c in enumerate(docs.columns) if c.lower() in ("lang_pred", "score", "spans")}
    found = language_id.detect(docs.withColumnsRenamed(names), model)
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).drop("lang_pred", "score", "spans")
    return found.withColumnsRenamed({v: k for k, v in names.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])


def _whole(docs: DataFrame, *columns: Column) -> DataFrame:
    """Each row as one column doc beside others, so that no name of docs can clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest doc_id; repeated rows are copies."""
    stay = near_copies.survivors(docs.select("doc_id", "text")).toDF("stay_id", "stay_hash")
    own = _whole(docs, F.col("doc_id").alias("id"), near_copies.text_hash().alias("hash"))
    own = own.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("hash") == F.col("stay_hash")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("hash", "id").orderBy(F.lit(0)))
    return own.withColumn("nth", nth).where("nth = 1").select("doc.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what repeats from documents of smaller doc_id; documents of which nothing is left go."""
    own = suffix_dedup.deduplicate(docs.withColumnsRenamed({c: f"keep_{c}" for c in docs.columns if c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}))
    own = own.where((F.col("n_removed") == 0) | (F.length("text") > 0)).drop("n_bytes", "n_removed", "n_spans", "kept_sha256")
    own = own.withColumnsRenamed({f"keep_{c}": c for c in docs.columns})
    if "n_chars" in docs.columns:
        own = own.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return own.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A null source is a source, null and empty texts have no words and are not taken, repeated rows share their number
    evenly, an empty table gives an empty result; no name of docs can clash with the operator's.
    """
    keyed = docs.select("doc_id", "source", "text", near_copies.text_hash().alias("hash"))
    taken = cube_mixing.mix(cube_mixing.sized(keyed).select("doc_id", "source", "size", "hash"), carry=("hash",))
    # Rows of one doc_id, source and text share their number evenly.
    times = taken.groupBy(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("hash").alias("t_hash")).agg(F.sum("times").alias("times"), F.count("*").alias("rows")).where("times > 0")
    own = _whole(docs, F.col("doc_id").alias("id"), F.col("source").alias("of"), near_copies.text_hash().alias("hash"))
    same = (F.col("hash") == F.col("t_hash")) & F.col("id").eqNullSafe(F.col("t_id")) & F.col("of").eqNullSafe(F.col("t_source"))
    own = own.join(times, same).withColumn("nth", F.row_number().over(Window.partitionBy("hash", "id", "of").orderBy(F.lit(0))) - 1)
    copies = F.floor(F.col("times") / F.col("rows")) + F.when(F.col("nth") < F.col("times") % F.col("rows"), 1).otherwise(0)
    return own.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("doc.*")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, and digests of the ids and of what they decode to.

    Null and empty texts have no ids; null doc_ids and repeated rows stay, texts are encoded whole, further columns go.
    """
    return bpe.encode(docs.select("doc_id", "source", "text")).drop("text")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("bpe", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again; what a stage has read goes when its own rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            versions.delete(spark, f"{folder}/{before}")
        before = name
    return docs
