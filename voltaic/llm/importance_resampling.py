"""Resampling documents to a target distribution by importance weights over hashed word buckets.

The sparse matrix of documents by buckets is stored once, as blocks of compressed sparse rows. Its column sums are the
corpus's distribution, those of the target's matrix the target's; a bucket's gain is the logarithm of their ratio, and
one product of the stored blocks with the vector of gains weighs every document. Both vectors have a fixed length.
Noise of the Gumbel distribution turns a draw without replacement into the highest scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, lean, segments, utf8

#: Columns of the matrix; gains are in thousandths.
BUCKETS, SCALE = 10_000, 1000
#: Words that a document needs to be drawn; percent of such documents that are drawn; the noise's seed.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Rows and stored counts of a block at most (a longer document is a block of its own), and words that a worker remembers.
BLOCK_ROWS, BLOCK_COUNTS, REMEMBERED = 2048, 500_000, 200_000
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Small letters, digits and all bytes of letters beyond ASCII stay; capitals become small; the rest parts words.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))

MATRIX = "doc_ids array<long>, words array<long>, starts binary, buckets binary, counts binary"


class _Buckets(dict):
    """The bucket of each word; short words are remembered, so many at most."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        bucket = zlib.crc32(word) % self.buckets
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = bucket
        return bucket


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end between words; a longer word stays whole."""
    text, start = text.translate(_KEPT), 0
    while start < len(text):
        end = start + PIECE
        if end < len(text):
            cut = text.rfind(b" ", start, end)
            cut = cut if cut > start else text.find(b" ", end)
            end = cut if cut >= 0 else len(text)
        yield text[start:end]
        start = end


def row(text: bytes, bucket_of: _Buckets) -> tuple[np.ndarray, np.ndarray, int]:
    """The buckets of a text's words in order, how many words are in each, and the number of words."""
    total, counts = 0, np.zeros(bucket_of.buckets, np.int64) if len(text) > PIECE else None
    for piece in _pieces(text):
        words = piece.split()
        own = np.fromiter(map(bucket_of.__getitem__, words), np.int64, len(words))
        total += len(words)
        if counts is None:
            return *np.unique(own, return_counts=True), total
        counts += np.bincount(own, minlength=bucket_of.buckets)
    if counts is None:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    at = np.flatnonzero(counts)
    return at, counts[at], total


def matrix(docs: DataFrame, id_: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Blocks of the documents-by-buckets matrix: doc_ids and words of its rows; starts (int64) of each row's entries, their buckets (int32) and counts (int64).

    A row for each row of docs, over its whole text; null texts have no entries.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = _Buckets(buckets)
        ids: list = []
        rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        stored = 0

        def block() -> pa.RecordBatch:
            starts = np.cumsum([0, *(len(b) for b, _, _ in rows)])
            parts = [starts, np.concatenate([b for b, _, _ in rows]).astype(np.int32), np.concatenate([c for _, c, _ in rows])]
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([[n for _, _, n in rows]], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["doc_ids", "words", "starts", "buckets", "counts"])

        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                ids.append(doc_id)
                rows.append(row(own, bucket_of))
                stored += len(rows[-1][0])
                if len(rows) >= BLOCK_ROWS or stored >= BLOCK_COUNTS:
                    yield block()
                    ids, rows, stored = [], [], 0
        if rows:
            yield block()

    return docs.select(F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(lean(of), MATRIX)


def _arrays(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, buckets, counts of a block."""
    return tuple(np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("starts", np.int64), ("buckets", np.int32), ("counts", np.int64)))  # type: ignore[return-value]


def column_sums(stored: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The matrix's column sums. Each task adds up its blocks; a number for each bucket reaches the driver."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                _, at, counts = _arrays(batch, i)
                np.add.at(total, at, counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in stored.select("starts", "buckets", "counts").mapInArrow(lean(of), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Each bucket's log ratio of target to corpus, each smoothed by one a bucket, floored in parts of 1/scale."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(scale * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weights(stored: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight: the product of the stored matrix with the gains, over each row's number of features, floored; 0 for no feature."""
    shared = stored.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                starts, at, counts = _arrays(batch, i)
                n = np.array(batch.column("words")[i].as_py(), np.int64)
                run, _ = segments(np.diff(starts))
                total = np.zeros(len(n), np.int64)
                np.add.at(total, run, counts * shared.value[at])
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_features", "weight"])

    return stored.mapInArrow(lean(of), "doc_id long, n_features long, weight long")


def scored(weighed: DataFrame, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """weighed with score: weight and Gumbel noise from the doc_id's digest, in parts of 1/scale, floored; a null doc_id counts as empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed.withColumn("score", (F.col("weight") + noise).cast("long"))


def ranked(own: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """own(doc_id, n_features, weight, score; durable) with rank: 1, 2, 3 .. of the drawn by falling score, then doc_id; null for the others.

    Scores are counted first: that table is short, as scores are whole numbers near the weights. Rows are then sorted
    by range of (score, doc_id) and numbered within their partition, after those of the partitions before it.
    """
    able = F.col("n_features") >= least_words
    n = own.where(able).count() * percent // 100
    if not n:
        return own.withColumn("rank", F.lit(None).cast("long"))
    by_score = own.where(able).groupBy("score").agg(F.count("*").alias("n"))
    upto = by_score.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("score"))))
    least = upto.where(F.col("upto") >= n).agg(F.max("score")).first()[0]
    may = able & (F.col("score") >= least)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    dealt = durable(own.where(may).repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    parts = dealt.groupBy("part_").agg(F.count("*").alias("n_"))  # a row for each partition
    ahead = parts.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))
    nth = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    placed = dealt.withColumn("nth_", nth).join(ahead, "part_").withColumn("rank", (F.col("before_") + F.col("nth_")).cast("long"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank"))).drop("part_", "nth_", "before_")
    return own.where(~F.coalesce(may, F.lit(False))).withColumn("rank", F.lit(None).cast("long")).unionByName(placed)


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs(doc_id, text); rank is null for those not drawn.

    target(text): the texts whose distribution the draw moves to. Null texts have no features and weight 0; null
    doc_ids come last among ties and share their noise; repeated rows count, and may be drawn, each; an empty table gives
    an empty result, an empty target a flat one; texts are taken whole; further columns are not read.
    """
    stored = durable(matrix(docs.select("doc_id", "text"), buckets=buckets))
    wanted = column_sums(matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets=buckets), buckets)
    gain = gains(column_sums(stored, buckets), wanted)
    return ranked(durable(scored(weights(stored, gain), seed)), percent, least_words)


def drawn(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows of docs, texts and all, whose doc_id was drawn; if a doc_id has several rows, all of them."""
    own = ranks.where("rank is not null").select(F.col("doc_id").alias("drawn_id_")).distinct()
    return docs.join(own, F.col("doc_id").eqNullSafe(F.col("drawn_id_")), "left_semi")


def query(spark, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(documents, benchmark)
