"""Choosing one document of each group of near copies: SimHash by anchors, then an exact join by the overlap of shingles.

Texts whose SimHash fingerprints link at the anchors of a covering code are judged first, by their whole sets of
shingles. Fingerprints miss many pairs near the threshold, so the rest are found exactly: the shingles of all texts have one order, those of rarely met cells first. Of two texts that overlap enough, the first shingle in that order that both have
stands near the front of both, so texts meet at the shingles of their fronts (prefix filter) and no pair is missed.
Every pair that meets and isn't joined already is judged by its whole sets, but for those whose sketches show that they
can't overlap enough: many texts may share the shingles of a core, and few of them be near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import durable, few, freeing, lean, parallelism, segments, small_batches, utf8
from .components import roots

#: Words of a shingle, least likeness of near copies.
WORDS, LIKENESS = 5, 0.8
#: Members of a small bucket that ask in the first round (see _meet), how that grows from round to round, and pairs for each.
DIRECT, GROWTH, SHARE = 16, 8, 64
#: Pairs of one text that one task judges.
PER_HUB = 1000
#: Cells of shingle counts; they order shingles and leave none out.
CELLS = 1 << 20
#: Members of buckets that are looked at together, and bytes of them; pairs that are compared at once, and bytes of their sketches.
MEMBERS, MEMBER_BYTES, PAIRS, PAIR_BYTES = 200_000, 32 << 20, 400_000, 32 << 20
#: Bits of a sketch: least and most. Larger sets than half of that have fewer bits a shingle, so more of their pairs are judged.
NARROW, WIDE = 64, 8192


def overlap(a: bytes, b: bytes) -> float:
    """Jaccard likeness of two sets of distinct 64-bit hashes, over all of them."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) and not len(y):
        return 1.0
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles, ascending; texts without words share one."""
    h = np.unique(simhash.shingle_hashes(text, WORDS))
    return h if len(h) else np.zeros(1, np.uint64)


def _cells(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(CELLS - 1)).astype(np.int64)


def sketch(h: np.ndarray) -> bytes:
    """Bits of distinct shingles, each flipped by every shingle that falls to it; two to four bits a shingle.

    Two sets differ in at least as many shingles as their sketches in bits. The halves of a sketch, one flipped by the
    other, are the sketch of half as many bits.
    """
    bits = min(max(NARROW, 1 << (2 * len(h) - 1).bit_length()), WIDE)
    at = (h >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _by_width(sketches: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The bytes of each sketch; for each number of bytes a table of the sketches that have it or twice as much (folded), and the row of each there."""
    width = np.fromiter(map(len, sketches), np.int64, len(sketches))
    tables = {}
    for w in np.unique(width).tolist():
        own, wider = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        halves = np.frombuffer(b"".join(sketches[wider]), np.uint64).reshape(len(wider), 2, w // 8)
        row = np.full(len(width), -1)
        row[own], row[wider] = np.arange(len(own)), len(own) + np.arange(len(wider))
        tables[w] = np.concatenate((np.frombuffer(b"".join(sketches[own]), np.uint64).reshape(len(own), w // 8), halves[:, 0] ^ halves[:, 1])), row
    return width, tables


def _least_apart(a: np.ndarray, b: np.ndarray, width: np.ndarray, tables: dict) -> np.ndarray:
    """For pairs of sketches (see _by_width), none over twice as wide as the other: shingles that are in one of the two sets only, at least."""
    out = np.zeros(len(a), np.int64)
    least = np.minimum(width[a], width[b])
    for w in np.unique(least).tolist():
        bits, row = tables[w]
        of = np.flatnonzero(least == w)
        for at in np.array_split(of, -(-len(of) * w // PAIR_BYTES)):
            out[at] = np.bitwise_count(bits[row[a[at]]] ^ bits[row[b[at]]]).sum(axis=1)
    return out


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each id that a task meets, so that copies don't fill the buckets of their shingles."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for x in batch.column("id").to_pylist():
            new.append(x not in seen)
            seen.add(x)
        if any(new):
            yield batch if all(new) else batch.filter(pa.array(new))


def surveyed(docs: DataFrame) -> DataFrame:
    """One pass over the texts. Rows with id and fp: each text's SimHash; the others, of a task: how many shingles are in each cell.

    The cells are a table of fixed size, in slices.
    """
    slices = 64

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        names = ["id", "fp", "slice", "n"]
        for batch in _once(batches):
            fps, own = [], []
            for text in utf8(batch.column("text")):
                h = simhash.shingle_hashes(text, WORDS)
                fps.append(simhash.fingerprint(h))
                own.append(np.unique(h) if len(h) else np.zeros(1, np.uint64))
            total += np.bincount(_cells(np.concatenate(own)), minlength=CELLS)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps, pa.int64()), pa.nulls(len(fps), pa.int32()), pa.nulls(len(fps), pa.binary())], names)
        if total.any():
            parts = [zstandard.compress(x.tobytes(), 1) for x in np.array_split(total, slices)]
            yield pa.RecordBatch.from_arrays([pa.nulls(slices, pa.int64()), pa.nulls(slices, pa.int64()), pa.array(range(slices), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.select("id", "text").mapInArrow(lean(of), "id long, fp long, slice int, n binary")


def counts(survey: DataFrame) -> np.ndarray:
    """How many shingles of all texts are in each cell; the slices of all tasks are added up on the executors."""

    def add(group):
        total = sum(np.frombuffer(zstandard.decompress(x), np.int64) for x in group["n"])
        return group[["slice"]].iloc[:1].assign(n=[np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()])

    got = survey.where("slice is not null").select("slice", "n").groupBy("slice").applyInPandas(add, "slice int, n binary").collect()
    return np.concatenate([np.frombuffer(r.n, np.uint32) for r in sorted(got, key=lambda r: r.slice)]) if got else np.zeros(CELLS, np.uint32)


def fronts(docs: DataFrame, weight: np.ndarray) -> DataFrame:
    """shingle, id, size, place: the shingles of each text's front, in the common order (count of the cell, hash)."""
    shared = docs.sparkSession.sparkContext.broadcast(weight)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _once(batches):
            rows: list[tuple[np.ndarray, int]] = []
            for text in utf8(batch.column("text")):
                h = shingles(text)
                # A near copy shares LIKENESS of them at least, so one of the first of both.
                front = len(h) - int(np.ceil(LIKENESS * len(h) - 1e-6)) + 1
                rows.append((h[np.argsort(shared.value[_cells(h)], kind="stable")[:front]], len(h)))
            run, place = segments([len(h) for h, _ in rows])
            ids, sizes = batch.column("id").to_numpy(zero_copy_only=False), np.array([n for _, n in rows], np.int32)
            hashes = np.concatenate([h for h, _ in rows]).view(np.int64) if rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(ids[run]), pa.array(sizes[run]), pa.array(place.astype(np.int32))], ["shingle", "id", "size", "place"])

    return docs.select("id", "text").mapInArrow(lean(of), "shingle long, id long, size int, place int")


def _meet(shingle, id_, size, place, asked, root, direct: int, sketches=None):
    """Pairs to judge of whole buckets (the members at a shingle), and the members of buckets that aren't done.

    With sketches, pairs that can't overlap by LIKENESS are left out.

    A member that asks is held against all members of other roots. Those of the bucket's largest root needn't ask: when
    all others did, only pairs that are joined already are left. In a round so many ask that a bucket gives about
    SHARE * direct pairs, those with the shingle nearest to the front first, who have few shingles of their own.
    """
    order = np.lexsort((root, id_, shingle))
    new = np.append(True, (shingle[order][1:] != shingle[order][:-1]) | (id_[order][1:] != id_[order][:-1]))[: len(order)]
    order = order[new]  # equal texts of several rows
    shingle, id_, size, place, asked, root = (x[order] for x in (shingle, id_, size, place, asked, root))
    width, tables = (None, None) if sketches is None else _by_width(sketches[order])
    n = len(shingle)
    edge = np.append(True, shingle[1:] != shingle[:-1])[:n]
    bucket = np.cumsum(edge) - 1
    lo = np.flatnonzero(edge)
    many = np.diff(np.append(lo, n))
    # The largest root of each bucket.
    by = np.lexsort((root, bucket))
    first = np.flatnonzero(np.append(True, (root[by][1:] != root[by][:-1]) | (bucket[by][1:] != bucket[by][:-1]))[:n])
    length = np.diff(np.append(first, n))
    top = np.lexsort((length, bucket[by][first]))
    last = np.append(bucket[by][first][top][1:] != bucket[by][first][top][:-1], True)[: len(top)]
    main = root[by][first][top[last]]
    ask = np.flatnonzero(~asked & (root != main[bucket]))
    ask = ask[np.lexsort((id_[ask], place[ask] / size[ask], bucket[ask]))]
    waiting = np.bincount(bucket[ask], minlength=len(lo))
    nth = np.arange(len(ask)) - (np.cumsum(waiting) - waiting)[bucket[ask]]
    may = np.maximum(1, SHARE * direct // np.maximum(many, 1))
    ask = ask[nth < may[bucket[ask]]]
    left = (waiting > may)[bucket]
    asked = asked.copy()
    asked[ask] = True
    found = []
    ends = np.cumsum(many[bucket[ask]])
    i = 0
    while i < len(ask):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        run, at = segments(many[bucket[ask[i:j]]])
        a, b = ask[i:j][run], lo[bucket[ask[i:j]]][run] + at
        # The most that both can share if this is the first shingle they share.
        most = np.minimum(size[a] - place[a], size[b] - place[b])
        ok = (root[a] != root[b]) & (most * (1 + LIKENESS) >= LIKENESS * (size[a].astype(np.int64) + size[b]) - 1e-6)
        a, b = a[ok], b[ok]
        if tables is not None:
            whole = size[a].astype(np.int64) + size[b]
            may_be = (whole - _least_apart(a, b, width, tables)) / 2 * (1 + LIKENESS) >= LIKENESS * whole - 1e-6
            a, b = a[may_be], b[may_be]
        found.append(np.unique(np.stack((np.minimum(id_[a], id_[b]), np.maximum(id_[a], id_[b]))), axis=1))
        i = j
    pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return pairs, tuple(x[left] for x in (shingle, id_, size, place, asked))


def _candidates(members: DataFrame, direct: int) -> DataFrame:
    """a, b of pairs to judge, and shingle, a, size, place, asked of members of buckets that need another round."""
    names = ["a", "b", "shingle", "size", "place", "asked"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts):
            cols = [np.concatenate(x) for x in zip(*parts)]
            pairs, (shingle, id_, size, place, asked) = _meet(*cols[:6], direct, *cols[6:])
            p, m = pairs.shape[1], len(id_)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), *(pa.nulls(p, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.bool_()))], names)
            yield pa.RecordBatch.from_arrays([pa.array(id_), pa.nulls(m, pa.int64()), pa.array(shingle), pa.array(size), pa.array(place), pa.array(asked)], names)

        parts: list[tuple[np.ndarray, ...]] = []
        rows = held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if (rows > MEMBERS or held > MEMBER_BYTES) and (cut or parts[-1][0][-1] != cols[0][0]):  # up to the last whole bucket
                parts.append(tuple(x[:cut] for x in cols))
                yield from found(parts)
                parts, rows, held, cols = [], 0, 0, tuple(x[cut:] for x in cols)
            parts.append(cols)
            rows, held = rows + len(cols[0]), held + batch.nbytes
        if parts:
            yield from found(parts)

    # Without a number, so that few members are few partitions: they become a file each.
    sent = members.repartition(F.col("shingle")).sortWithinPartitions("shingle")
    return sent.mapInArrow(lean(compare), "a long, b long, shingle long, size int, place int, asked boolean")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingles(t).tobytes() for t in utf8(batch.column("text"))], pa.binary())], ["id", "own"])


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of these ids, once each."""
    return docs.join(few(ids), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))


def _sketches(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, sketch of the texts of these ids, durable."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([sketch(shingles(t)) for t in utf8(batch.column("text"))], pa.binary())], ["id", "sketch"])

    with small_batches(docs.sparkSession):
        return durable(_texts(docs, ids).mapInArrow(lean(of), "id long, sketch binary"))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of a, each a's own set before those of the b it is held against: the pairs that are near copies."""
    hub, own = None, b""
    for batch in batches:
        a, b = [], []
        for x, y, z in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "own"))):
            if y is None:
                hub, own = x, z
            elif hub == x and overlap(own, z) >= LIKENESS:
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (durable, distinct) whose whole sets of shingles overlap by LIKENESS or more."""
    # The text of more pairs is the one that is sent once to each task that judges some of them: a hub.
    often = durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n")))
    with small_batches(docs.sparkSession):
        sets = durable(_texts(docs, often.select("id")).mapInArrow(lean(_sets), "id long, own binary"))
    with_n = pairs.join(often.toDF("a", "na"), "a").join(often.toDF("b", "nb"), "b")
    first = F.col("na") >= F.col("nb")
    turned = with_n.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("id"), F.greatest("na", "nb").alias("many"))
    # A hub of many pairs is judged in several tasks.
    salts = F.ceil(F.col("many") / PER_HUB).cast("int")
    turned = turned.select("a", "id", salts.alias("salts"), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    hubs = turned.groupBy("a").agg(F.max("salts").alias("salts")).select(F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hubs = hubs.join(sets, "id").select(F.col("id").alias("a"), "salt", F.lit(None).cast("long").alias("b"), "own")
    rows = hubs.unionByName(turned.join(sets, "id").select("a", "salt", F.col("id").alias("b"), "own"))
    n = parallelism(docs.sparkSession)
    with small_batches(docs.sparkSession):
        judged = rows.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(lean(_judged), "a long, b long")
        return durable(judged.distinct())  # the links are few: one file or some, not one of each task


def _by_fingerprint(survey: DataFrame) -> DataFrame:
    """a, b: texts of equal fingerprints, and of fingerprints that link at the anchors, each held against one of them."""
    fps = survey.where("slice is null").groupBy("fp").agg(F.min("id").alias("head"))
    heads = durable(fps)
    same = survey.where("slice is null").select("id", "fp").join(heads, "fp").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    near = simhash.links(heads).join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return durable(same.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def survivors(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash of the documents that stay: of each group that links join, the one of smallest doc_id.

    Equal texts are one class. Two classes are linked if their sets of shingles overlap by LIKENESS or more; every such
    two are in one group. Those that the anchors of their SimHash fingerprints bring together are judged first. Where many
    meet at a shingle, some are held against all others first, and only those that no link has joined by then go on
    (see _meet), in rounds until every pair is judged or joined, or can't be linked by its sketches (see sketch).
    Null doc_ids come last, null texts are empty, repeated rows count once, empty tables give empty results; long texts
    are taken whole.
    """
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    other = F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))
    with freeing(docs.sparkSession):
        classes = durable(docs.select(text_hash().alias("text_hash"), other.alias("other"), "doc_id").groupBy("text_hash").agg(F.min(key).alias("key"), (F.min("other") != F.max("other")).alias("mixed")))
        mixed = classes.where("mixed").select("text_hash")
        apart = None
        if not mixed.isEmpty():  # unlike texts of one hash stay as they are, but for equal ones
            whole = docs.withColumn("text_hash", text_hash())
            apart = whole.join(mixed, "text_hash", "left_semi").groupBy("text_hash", other.alias("other")).agg(F.min(key).alias("k"))
            docs, classes = whole.join(mixed, "text_hash", "left_anti").drop("text_hash"), classes.where("not mixed")
        linked = _linked(docs.select(text_hash().alias("id"), "text"))
    best = classes.join(few(linked.toDF("text_hash", "root")), "text_hash", "left").groupBy(F.coalesce("root", "text_hash").alias("root")).agg(F.min(F.struct("key", "text_hash")).alias("k"))
    out = best.select(F.col("k.key.doc_id").alias("doc_id"), F.col("k.text_hash").alias("text_hash"))
    return out if apart is None else out.unionByName(apart.select(F.col("k.doc_id").alias("doc_id"), "text_hash"))


def _linked(own: DataFrame) -> DataFrame:
    """node, root of own(id, text; equal ids are equal texts) that isn't the smallest of its group."""
    spark = own.sparkSession
    with small_batches(spark, 4000):
        survey = durable(surveyed(own))
    found_roots, direct = roots(_links(own, _by_fingerprint(survey))), DIRECT
    members, sketches = fronts(own, counts(survey)), None
    while True:
        named = members.join(few(found_roots.toDF("id", "root")), "id", "left").select("shingle", "id", "size", "place", *(["asked"] if "asked" in members.columns else [F.lit(False).alias("asked")]), F.coalesce("root", "id").alias("root"))
        if sketches is not None:
            named = named.join(sketches, "id").select("shingle", "id", "size", "place", "asked", "root", "sketch")
        with small_batches(spark, 4000):
            found = durable(_candidates(named, direct))
        links = _links(own, durable(found.where("b is not null").select("a", "b").distinct()))
        found_roots = roots(links.unionByName(found_roots.toDF("a", "b")))
        members = found.where("b is null").select("shingle", F.col("a").alias("id"), "size", "place", "asked")
        if members.isEmpty():
            return found_roots
        # Those that go on past the first round are few of all texts, and later rounds have no others.
        sketches = _sketches(own, members.select("id").distinct()) if sketches is None else sketches
        direct *= GROWTH
