"""SimHash near-duplicates by anchor points of a covering code.

Anchors are the words of products of the perfect binary Golay code: length 23, 4096 words, every point within
distance 3 of exactly one. A fingerprint's home is the anchor that its bits decode to. One within t bits of it has
its home within 3 + t of it, so each fingerprint goes to all anchors that t flips can reach, and at each anchor those
at home are compared with all that came. No pair within the threshold is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, extended, lean, parallelism, segments, utf8
from .components import least_labels, stars

SEED = 42
#: The generator polynomial of the binary Golay code, its length and covering radius.
GOLAY, LENGTH, RADIUS = 0b110001110101, 23, 3
#: Bit runs (first bit, width) whose anchors are taken together. Two full blocks: 2**24 anchors.
TWO_BLOCKS = (((0, 23), (23, 23)),)
#: Three bands of one block each: of t differing bits, some band has t // 3 at most.
THREE_BANDS = (((0, 22),), ((22, 21),), ((43, 21),))
#: Pairs that are compared at once.
PAIRS = 400_000


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of so many words, A-Z lower-cased; of the whole sequence if there are fewer."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    n = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is in over half the hashes; 0 for none. As a signed 64-bit number."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 100_000):
        part = hashes[i : i + 100_000]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, sketch: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, the columns of carry and, if sketch, the smallest so many distinct hashes (low 32 bits) as bytes; a row per row, over whole texts.

    Null and blank texts have fp 0.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, kept = [], []
            for text in utf8(batch.column("text")):
                h = shingle_hashes(text, words)
                fps.append(fingerprint(h))
                if sketch:
                    kept.append(np.unique((h & np.uint64(0xFFFFFFFF)).astype(np.uint32))[:sketch].tobytes())
            cols = {"doc_id": batch.column("doc_id"), **{c: batch.column(c) for c in carry}, "fp": pa.array(fps, pa.int64())}
            if sketch:
                cols["sketch"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    own = docs.select("doc_id", *carry)
    return docs.select("doc_id", "text", *carry).mapInArrow(lean(of), extended(own, "fp long" + (", sketch binary" if sketch else "")))


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each 12-bit head; each remainder's error pattern (of weight 3 at most)."""
    head = np.arange(4096, dtype=np.int64)
    x = head << 11
    for bit in range(22, 10, -1):
        x = np.where(x >> bit & 1, x ^ (GOLAY << (bit - 11)), x)
    points = np.array([0, *(1 << i for i in range(23))], np.int64)
    low = np.unique(np.bitwise_xor.outer(np.bitwise_xor.outer(points, points), points))
    low = low[np.bitwise_count(low) <= RADIUS]
    leader = np.zeros(2048, np.int64)
    leader[x[low >> 11] ^ (low & 2047)] = low
    return x, leader


@cache
def _reach(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each remainder the anchors (as change of the home's head) that up to `most` flips reach, least flips first.

    heads and flips end to end; where each remainder's run starts; how many it has for 0, 1, .. most flips.
    """
    rest, leader = _golay()
    word = np.arange(4096, dtype=np.int64) << 11 | rest
    heads, flips, counts = [], [], []
    for e in leader:
        need = np.maximum(np.bitwise_count(word ^ e).astype(np.int64) - RADIUS, 0)
        own = np.flatnonzero(need <= most)
        own = own[np.argsort(need[own], kind="stable")]
        heads.append(own)
        flips.append(need[own])
        counts.append([(need <= f).sum() for f in range(most + 1)])
    sizes = np.array([len(x) for x in heads])
    return np.concatenate(heads), np.concatenate(flips), np.cumsum(sizes) - sizes, np.array(counts)


def anchors(fp: np.ndarray, bands: tuple, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, anchor, home: every anchor that each fingerprint goes to."""
    rest, leader = _golay()
    heads, flips, start, counts = _reach(most)
    out = []
    bits = fp.view(np.uint64)
    for number, blocks in enumerate(bands):
        row, anchor, left, home = np.arange(len(fp)), np.full(len(fp), number, np.int64), np.full(len(fp), most), np.ones(len(fp), bool)
        for first, width in blocks:
            x = (bits >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
            error = rest[x >> 11] ^ (x & 2047)
            centre = (x ^ leader[error]) >> 11
            many = counts[error[row], left]
            run, place = segments(many)
            at = start[error[row[run]]] + place
            row, anchor, left, home = row[run], (anchor[run] << 12) | (centre[row[run]] ^ heads[at]), left[run] - flips[at], home[run] & (heads[at] == 0)
        out.append((row, anchor, home))
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def _linked(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, most: int, direct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, star: links through these anchors.

    direct = 0: a spanning star, one row per fingerprint that isn't the smallest of those it is joined to. Else every
    fingerprint at home names its partners, all of whom come here: pairs (larger, smaller) if there are `direct` or
    fewer, or else (own, partner, star) for the `direct` that most fingerprints here are partners of.
    """
    order = np.argsort(anchor, kind="stable")
    anchor, fp, home = anchor[order], fp[order], home[order]
    at = np.flatnonzero(home)
    lo, hi = np.searchsorted(anchor, anchor[at], "left"), np.searchsorted(anchor, anchor[at], "right")
    values, node = np.unique(fp, return_inverse=True)
    label = np.arange(len(values))
    named = []
    many = hi - lo
    done = np.cumsum(many)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + PAIRS, "right")))
        run, place = segments(many[i:j])
        a, b = at[i:j][run], lo[i:j][run] + place
        near = np.flatnonzero((np.bitwise_count(fp[a] ^ fp[b]) <= most) & (fp[a] != fp[b]))
        run, a, b = run[near], a[near], b[near]
        if direct and len(near):
            partners = np.bincount(b, minlength=len(fp))[b]
            best = np.lexsort((fp[b], -partners, run))
            run, x, y = run[best], fp[a[best]], fp[b[best]]
            count = np.bincount(run, minlength=j - i)
            star = count[run] > direct
            keep = np.arange(len(run)) - (np.cumsum(count) - count)[run] < direct
            named.append((np.where(star, x, np.maximum(x, y))[keep], np.where(star, y, np.minimum(x, y))[keep], star[keep]))
        elif len(near):
            # What was found before counts as links too, so a large group never holds more than one label each.
            old = np.flatnonzero(label != np.arange(len(values)))
            label = least_labels(np.concatenate((node[a], old)), np.concatenate((node[b], label[old])), len(values))
        i = j
    if direct:
        return tuple(np.concatenate(p) for p in zip(*named)) if named else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))  # type: ignore[return-value]
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]], np.ones(len(moved), bool)


def links(distinct: DataFrame, most: int = 2, bands: tuple = TWO_BLOCKS, direct: int = 0) -> DataFrame:
    """a, b, star: links that join every two of the distinct fingerprints fp that differ in `most` bits or fewer, directly or through others.

    Each anchor reports a spanning star, so a large group of near copies gives one row per member and anchor; links of
    stars may differ in more bits. With `direct` it reports named pairs instead (see _linked), so many a fingerprint at most.
    """
    each = most // len(bands)
    n = parallelism(distinct.sparkSession)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 4096):
                row, anchor, home = anchors(np.ascontiguousarray(fp[i : i + 4096]), bands, each)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[i : i + 4096][row]), pa.array(home)], ["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _linked(*(np.concatenate(x) for x in zip(*parts)), most, direct)], ["a", "b", "star"])

        parts: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if rows > 500_000 and (cut or parts[-1][0][-1] != cols[0][0]):  # up to the last whole anchor
                parts.append(tuple(x[:cut] for x in cols))
                yield found(parts)
                parts, rows, cols = [], 0, tuple(x[cut:] for x in cols)
            parts.append(cols)
            rows += len(cols[0])
        if parts:
            yield found(parts)

    sent = distinct.select("fp").repartition(n).mapInArrow(lean(replicate), "anchor long, fp long, home boolean")
    out = sent.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(lean(compare), "a long, b long, star boolean")
    return out.groupBy("a", "b").agg(F.bool_and("star").alias("star"))


def components(fps: DataFrame, most: int = 2, bands: tuple = TWO_BLOCKS) -> DataFrame:
    """fps(doc_id, fp, ..) with component_id: the smallest doc_id reachable over links of `most` differing bits or fewer.

    Equal fingerprints are one node, whatever their number. Null doc_ids count only where nothing else is there; repeated
    rows stay; an empty table gives an empty result; further columns pass through.
    """
    classes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("low_")))
    star = stars(links(classes, most, bands))
    rooted = classes.join(star.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root_", F.coalesce("root", "fp"))
    low = rooted.groupBy("root_").agg(F.min("low_").alias("component_id"))
    by_fp = rooted.join(low, "root_").select(F.col("fp").alias("fp_"), "component_id")
    return fps.join(by_fp, F.col("fp") == F.col("fp_")).drop("fp_")


def query(spark, documents: DataFrame) -> DataFrame:
    out = components(durable(fingerprints(documents)))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
