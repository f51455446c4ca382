"""SpotSigs document fingerprints.

A spot is an anchor (a very common word) and the chain of the next content words behind it, anchors skipped. A
document's signature is the set of its spots; repeats count as spots of their own, by their number. Signatures compare
by Jaccard likeness. For a similarity join they are partitioned by set length, so that only sets of lengths that can
reach the threshold meet, and within a partition by their rarest spots, with an exact check that stops early.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, parallelism, texts
from .components import stars

#: Very common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from has have he her his i in is it its not of on or she that the their they this to was were which will with you "
    "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist man mit nach nicht noch oder sich sie sind so über um und von vor war was wenn wie wird zu zum zur "
    "al como con cuando del desde donde el ella entre era es esta este fue ha hay la las lo los más muy no nos o para pero por que se sin sobre su sus también un una y ya"
)
#: Content words in a chain.
CHAIN = 3
#: Characters that are worked on at once; a longer text is worked on alone.
PIECE = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@cache
def _word_bytes() -> np.ndarray:
    """Bytes of words: letters, digits and all that isn't ASCII."""
    return np.array([i >= 0x80 or chr(i).isalnum() for i in range(256)])


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x100000001B3
    up = np.cumprod(np.full(n, base, np.uint64))
    down = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))
    return up, down


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of data."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(_word_bytes()[raw].astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    n = 1 << max(10, int(len(raw) + 1).bit_length())
    up, down = _powers(n)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
    return _mixed((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * MIX), start


@cache
def _anchor_hashes(anchors: str) -> np.ndarray:
    return np.unique(word_hashes(anchors.encode())[0])


def signatures(items: list[str], anchors: str = ANCHORS, chain: int = CHAIN) -> list[np.ndarray]:
    """Each text's sorted distinct spots as 32-bit hashes.

    A text too short for a spot has its words instead, one without words an empty set.
    """
    out: list[np.ndarray] = []
    i = 0
    while i < len(items):
        j, size = i, 0
        while j < len(items) and (j == i or size + len(items[j]) <= PIECE):
            size += len(items[j]) + 1
            j += 1
        out += _signatures([x.lower().encode("utf-8", "surrogatepass") for x in items[i:j]], anchors, chain)
        i = j
    return out


def _signatures(items: list[bytes], anchors: str, chain: int) -> list[np.ndarray]:
    h, start = word_hashes(b"\n".join(items))
    ends = np.cumsum(np.fromiter(map(len, items), np.int64, len(items)) + 1)
    text = np.searchsorted(ends, start, "right")
    common = _anchor_hashes(anchors)
    at = np.searchsorted(common, h)
    anchor = common[np.minimum(at, len(common) - 1)] == h
    content = np.flatnonzero(~anchor)
    spots = np.flatnonzero(anchor)
    first = np.searchsorted(content, spots)
    fits = first + chain <= len(content)
    spots, first = spots[fits], first[fits]
    if len(spots):
        fits = text[content[first + chain - 1]] == text[spots]
        spots, first = spots[fits], first[fits]
    sig = h[spots]
    for k in range(chain):
        sig = _mixed(sig * MIX + h[content[first + k]]) if len(sig) else sig
    own = text[spots]
    bare = np.flatnonzero(~np.isin(text, own))  # words of texts without a spot
    own, sig = np.concatenate((own, text[bare])), np.concatenate((sig, h[bare]))
    # The n-th repeat is a spot of its own.
    order = np.lexsort((sig, own))
    own, sig = own[order], sig[order]
    new = np.append(True, (np.diff(own) != 0) | (sig[1:] != sig[:-1])) if len(sig) else np.empty(0, bool)
    place = np.arange(len(sig)) - np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0)) if len(sig) else np.empty(0, np.int64)
    low = (_mixed(sig + place.astype(np.uint64) * MIX) >> np.uint64(32)).astype(np.uint64)
    key = np.unique(own.astype(np.uint64) << np.uint64(32) | low)
    cut = np.searchsorted(key, np.arange(1, len(items), dtype=np.uint64) << np.uint64(32))
    return np.split((key & np.uint64(0xFFFFFFFF)).astype(np.uint32), cut)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two signatures; 1 for two empty ones; 0 without a look where lengths keep it below least."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large:
        return 0.0
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (small + large - common)


def encoded(signature: np.ndarray) -> str:
    """The fingerprint: number of spots, then their sorted hashes in base 64."""
    return f"{len(signature)}:{base64.b64encode(signature.astype('<u4').tobytes()).decode()}"


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), "<u4")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text; null counts as empty, equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [encoded(x) for x in signatures(texts(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, component_id, links: near-duplicates by SpotSigs likeness of threshold or more.

    class_id is the smallest doc_id with the same fingerprint, component_id the smallest reachable over links, links
    the number of other classes that the class is linked to. Classes meet where their length classes are the same or
    neighbours and they share one of their rarest spots (so many that no pair is missed), rarity counted over all
    documents. Copies are one class, so a large group of copies is one candidate.
    """
    prints = durable(fingerprints(docs))
    classes = durable(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")))

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [decoded(x) for x in batch.column("fingerprint").to_pylist()]
            ids = np.repeat(batch.column("class_id").to_numpy(zero_copy_only=False), [len(x) for x in sets])
            sizes = np.repeat([len(x) for x in sets], [len(x) for x in sets]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(flat.astype(np.int64))], ["class_id", "size", "spot"])

    each = classes.mapInArrow(spots, "class_id long, size int, spot long")
    seldom = each.groupBy("spot").count()
    # A pair that reaches the threshold shares a spot among the first size - ceil(threshold * size) + 1 in any fixed order.
    order = Window.partitionBy("class_id").orderBy("count", "spot")
    ahead = each.join(seldom, "spot").withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).where("count > 1")
    level = F.floor(F.log(F.col("size").cast("double")) / -math.log(threshold)).cast("int")
    ahead = durable(ahead.withColumn("level", level).select("class_id", "size", "spot", "level"))
    other = ahead.select(F.col("class_id").alias("b"), F.col("size").alias("size_b"), "spot", F.explode(F.array("level", F.col("level") - 1, F.col("level") + 1)).alias("level"))
    fits = (F.col("class_id") < F.col("b")) & (F.least("size", "size_b") >= F.lit(threshold) * F.greatest("size", "size_b") - 1e-9)
    pairs = ahead.join(other, ["spot", "level"]).where(fits).select(F.col("class_id").alias("a"), "b").distinct()
    named = classes.select(F.col("class_id"), "fingerprint")
    wide = pairs.join(named.toDF("a", "left_"), "a").join(named.toDF("b", "right_"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = [likeness(decoded(x), decoded(y), threshold) for x, y in zip(batch.column("left_").to_pylist(), batch.column("right_").to_pylist())]
            good = pa.array([x >= threshold for x in like], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(good)

    edges = durable(wide.select("a", "b", "left_", "right_").mapInArrow(verify, "a long, b long"))
    degree = edges.select("a").union(edges.select("b")).groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("links"))
    roots = stars(edges).toDF("class_id", "root")
    done = classes.join(degree, "class_id", "left").join(roots, "class_id", "left")
    done = done.select(F.col("fingerprint").alias("print_"), "class_id", F.coalesce("root", "class_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return prints.join(done, F.col("fingerprint") == F.col("print_")).select("doc_id", "class_id", "component_id", "links")


def with_next(docs: DataFrame, of) -> DataFrame:
    """of(texts, next texts) per run of rows, where each row's next is that of the next smaller doc_id (the last's: the first).

    Rows are dealt by ranges of doc_id; the first row of each range goes also to the range before it, so no range needs
    another. The ranges' bounds and first rows are as many as there are partitions. Equal doc_ids follow each other by
    text; null doc_ids come last, null texts count as empty, texts are taken whole, an empty table gives an empty result.
    """
    n = parallelism(docs.sparkSession)
    ids = durable(docs.select("doc_id"))
    bounds = sorted({int(x) for x in ids.where("doc_id is not null").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)}, reverse=True) if n > 1 else []
    # Range 0 has the largest doc_ids; nulls are in the last.
    below = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(F.size(F.filter(below, lambda b: F.col("doc_id") < b)))
    heads = {r[0]: r[1] for r in ids.groupBy(part.alias("part")).agg(F.max("doc_id")).collect()}
    there = sorted(heads)
    before = {p: there[i - 1] for i, p in enumerate(there)}
    cases = None
    for p in there:
        own = (part == p) & F.col("doc_id").eqNullSafe(F.lit(heads[p]).cast("long"))
        cases = F.when(own, before[p]) if cases is None else cases.when(own, before[p])
    sides = F.array(F.struct(part.alias("part"), F.lit(False).alias("halo")), F.struct((F.lit(None).cast("int") if cases is None else cases).alias("part"), F.lit(True).alias("halo")))
    dealt = docs.select(F.explode(sides).alias("to"), "doc_id", "text").select("to.*", "doc_id", "text").where("part is not null")
    dealt = dealt.repartition(max(n, 1), "part").sortWithinPartitions("part", "halo", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return dealt.mapInArrow(of, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[bool, int | None, str]] = []
    size = 0

    def found() -> pa.RecordBatch:
        own = [i for i in range(len(held) - 1) if not held[i][0]]
        plain = signatures([x[2] for x in held])
        edits = []
        for i in own:
            text, after = held[i][2], held[i + 1][2]
            cut = len(text) // 3
            edits.append(text[: len(text) - cut] + after[:cut])
        edited = signatures(edits)
        rows = [
            (held[i][1], len(held[i][2]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), encoded(plain[i]), encoded(s), likeness(plain[i], s), likeness(plain[i], plain[i + 1]))
            for i, e, s in zip(own, edits, edited)
        ]
        kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
        cols = list(zip(*rows)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds.values())], list(kinds))

    for batch in batches:
        for halo, doc_id, text in zip(batch.column("halo").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
            held.append((halo, doc_id, text))
            size += len(text)
            if size > PIECE:  # the last row waits for its next one
                yield found()
                held, size = held[-1:], len(held[-1][2])
    if held:
        yield found()


def query(spark, documents: DataFrame) -> DataFrame:
    return with_next(documents.select("doc_id", "text"), _compare)
