"""An exact Jaccard join of documents by word n-grams through a token-group matrix.

Documents whose sets have the same least hashes (likely where the sets are alike) form groups of 64 at most. A group
stores the union of its members' tokens and, for each token, a bit for each member that has it: its rows of the matrix.
How many of a document's tokens are in a group's union bounds what it can share with any member, so a group is opened,
that is its bits are counted, only for documents that the bound lets pass. Which groups may pass at all is found by
tokens in one common order, rare ones first: two sets that overlap enough share a token near the front of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, few, freeing, lean, parallelism, segments, small_batches, utf8
from .components import least_labels, roots
from .simhash import shingle_hashes

#: Words of a shingle; least likeness in percent.
WORDS, PERCENT = 4, 85
#: Members of a group at most, and tokens of its members beyond which none is added.
MEMBERS, TOKENS = 64, 300_000
#: Cells of token counts, which order tokens and leave none out, and the slices that carry them.
CELLS, SLICES = 1 << 20, 64
#: Sets of one least hash that one task groups, and postings of a token that one bucket takes, by what its cell counts beyond most others.
DEALT, HOT = 2000, 50_000
#: Postings of small buckets that ask in the first round (see _meet), how that grows from round to round, and pairs for each.
DIRECT, GROWTH, SHARE = 16, 8, 64
#: Pairs of one group that one task judges; postings looked at together; pairs compared at once; tokens counted at once.
PER_HUB, POSTINGS, PAIRS, ROWS = 1000, 200_000, 400_000, 1 << 16

NARROW = "doc_id long, n_shingles long, key binary, slice int, n binary"
SETS = "deal long, m1 long, m2 long, m3 long, key binary, own binary"
GROUPS = "gid long, members int, keys binary, sizes binary, tokens binary, bits binary, local binary"
POSTING = "key long, node long, lo int, hi int, left int, asked boolean"


def token_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, ascending: of every run of so many words, or of the whole sequence if there are fewer."""
    return np.unique(shingle_hashes(text, words))


def _tokens(h: np.ndarray) -> np.ndarray:
    """48-bit tokens of a set's hashes, ascending: a quarter less to store and send."""
    return np.unique(h >> np.uint64(16))


def _packed(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


def _cells(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(CELLS - 1)).astype(np.int64)


def _salts(excess: np.ndarray, each: int) -> np.ndarray:
    """Tasks or blocks for tokens whose cells count so many sets more than most cells."""
    return np.maximum(1, -(-excess.astype(np.int64) // each))


def surveyed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One pass over the texts. Rows with slice null: each row's doc_id, set size and 128-bit digest of the set; the others: how many sets a task met with tokens in each cell.

    A set that a task meets again counts once. Texts without words have the empty set and a null key.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(CELLS, np.int64), set()
        names = ["doc_id", "n_shingles", "key", "slice", "n"]
        for batch in batches:
            sizes, keys = [], []
            for text in utf8(batch.column("text")):
                h = token_set(text, words)
                key = xxhash.xxh128_digest(h.tobytes()) if len(h) else None
                sizes.append(len(h))
                keys.append(key)
                if key is not None and key not in seen:
                    seen.add(key)
                    np.add.at(total, _cells(_tokens(h)), 1)
            m = len(keys)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        if seen:
            parts = [zstandard.compress(x.tobytes(), 1) for x in np.array_split(total, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(of), NARROW)


def counts(survey: DataFrame) -> np.ndarray:
    """How many sets have tokens in each cell, and how many more that is than twice what half of the cells have: about those of a frequent token.

    Tasks' slices are added up on the executors; a table of fixed size reaches the driver.
    """

    def add(group):
        total = sum(np.frombuffer(zstandard.decompress(x), np.int64) for x in group["n"])
        return group[["slice"]].iloc[:1].assign(n=[np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()])

    got = survey.where("slice is not null").select("slice", "n").groupBy("slice").applyInPandas(add, "slice int, n binary").collect()
    n = np.concatenate([np.frombuffer(r.n, np.uint32) for r in sorted(got, key=lambda r: r.slice)]) if got else np.zeros(CELLS, np.uint32)
    return np.stack((n, np.maximum(n.astype(np.int64) - 2 * int(np.median(n)), 0).astype(np.uint32)))


def _sets(docs: DataFrame, weight, words: int) -> DataFrame:
    """Each set that is not empty, once a task, with its three least hashes and the number by which it is dealt.

    Sets of one least hash go to one task, or to several where its cell counts many.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows: list[tuple[int, int, int, int, bytes, bytes]] = []
            for text in utf8(batch.column("text")):
                h = token_set(text, words)
                key = xxhash.xxh128_digest(h.tobytes())
                if not len(h) or key in seen:
                    continue
                seen.add(key)
                h = _tokens(h)
                low = h[:3].view(np.int64).tolist()
                salts = int(_salts(weight.value[1][_cells(h[:1])], DEALT)[0])
                salt = int.from_bytes(key[:8], "little") % salts
                deal = int(_mixed(h[:1] + np.uint64(salt)).view(np.int64)[0])
                rows.append((deal, *(low + [0, 0])[:3], key, _packed(h)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["deal", "m1", "m2", "m3", "key", "own"])

    return docs.select("text").mapInArrow(lean(of), SETS)


def _bits(packed: np.ndarray, members: int) -> np.ndarray:
    """A row for each token, a 0 or 1 for each member."""
    return np.unpackbits(packed, axis=1, count=members, bitorder="little")


def _alike(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Where shared tokens are `percent` of the union of sets of sizes a and b."""
    return 100 * shared >= percent * (a + b - shared)


class Group:
    """Some sets: the union of their tokens, a bit for each token and member, and the members' sizes.

    local: for each member the first of those that links within the group join it to.
    """

    def __init__(self, gid: int, sizes: np.ndarray, tokens: np.ndarray, bits: np.ndarray | None, local: np.ndarray | None = None):
        self.gid, self.sizes, self.tokens, self.bits, self.local = gid, sizes, tokens, bits, local

    @classmethod
    def of(cls, gid: int, sets: list[np.ndarray], percent: int) -> Group:
        sizes = np.array([len(s) for s in sets], np.int64)
        if len(sets) == 1:
            return cls(gid, sizes, sets[0], None, np.zeros(1, np.int64))
        tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
        member = np.repeat(np.arange(len(sets)), sizes)
        bits = np.zeros((len(tokens), -(-len(sets) // 8)), np.uint8)
        np.bitwise_or.at(bits, (at, member >> 3), (1 << (member & 7)).astype(np.uint8))
        out = cls(gid, sizes, tokens, bits)
        a, b = np.nonzero(np.triu(_alike(out.overlaps(out, np.arange(len(sets)), np.arange(len(tokens)), np.arange(len(tokens))), sizes[:, None], sizes, percent), 1))
        out.local = least_labels(a, b, len(sets))
        return out

    @classmethod
    def stored(cls, gid: int, sizes: bytes, tokens: bytes, bits: bytes, local: bytes) -> Group:
        n, own = len(local), _unpacked(tokens)
        return cls(gid, np.frombuffer(sizes, np.int64), own, np.frombuffer(bits, np.uint8).reshape(len(own), -1) if n > 1 else None, np.frombuffer(local, np.uint8).astype(np.int64))

    def columns(self) -> tuple:
        return self.sizes.tobytes(), _packed(self.tokens), b"" if self.bits is None else self.bits.tobytes(), self.local.astype(np.uint8).tobytes()

    def part(self, at: np.ndarray) -> np.ndarray:
        """0 or 1 for the tokens at these places and each member."""
        return np.ones((len(at), 1), np.uint8) if self.bits is None else _bits(self.bits[at], len(self.sizes))

    def overlaps(self, other: Group, rows: np.ndarray, mine: np.ndarray, its: np.ndarray) -> np.ndarray:
        """Tokens that my members `rows` and each of its members share, of the common tokens at places mine and its."""
        out = np.zeros((len(rows), len(other.sizes)), np.int64)
        for i in range(0, len(mine), ROWS):
            a, b = self.part(mine[i : i + ROWS])[:, rows].astype(np.float32), other.part(its[i : i + ROWS]).astype(np.float32)
            out += (a.T @ b).astype(np.int64)
        return out

    def links(self, other: Group, percent: int) -> Iterator[tuple[int, int]]:
        """Nodes of my members and its members whose sets are alike. The group is opened for the members that its union lets pass."""
        at = np.searchsorted(other.tokens, self.tokens)
        at[at == len(other.tokens)] = 0
        mine = np.flatnonzero(other.tokens[at] == self.tokens)
        if 100 * len(mine) < percent * self.sizes.min():
            return
        bound = np.array([len(mine)]) if self.bits is None else sum(self.part(mine[i : i + ROWS]).sum(axis=0, dtype=np.int64) for i in range(0, len(mine), ROWS))
        able = np.flatnonzero(100 * bound >= percent * self.sizes)
        if len(able):
            shared = self.overlaps(other, able, mine, at[mine]) if len(self.sizes) + len(other.sizes) > 2 else np.array([[len(mine)]])
            a, b = np.nonzero(_alike(shared, self.sizes[able][:, None], other.sizes, percent))
            for x, y in {(int(self.local[able[i]]), int(other.local[j])) for i, j in zip(a, b)}:
                yield self.gid << 6 | x, other.gid << 6 | y


def grouped(docs: DataFrame, weight: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The token-group matrix, a row for each group: gid, members, and as bytes: their keys, sizes, the union's tokens, the bits, and local.

    Sets in order of their least hashes fill a group as long as the least one stays the same.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weight)  # of fixed size

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        keys: list[bytes] = []
        sets: list[np.ndarray] = []
        least, held = None, 0
        rows: list[tuple] = []

        def close() -> None:
            nonlocal made, keys, sets, held
            if sets:
                rows.append((task << 32 | made, len(sets), b"".join(keys), *Group.of(task << 32 | made, sets, percent).columns()))
                made, keys, sets, held = made + 1, [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal rows
            cols = list(zip(*rows)) or [()] * 7
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), *[pa.binary()] * 5])], ["gid", "members", "keys", "sizes", "tokens", "bits", "local"])

        for batch in batches:
            for m1, key, own in zip(*(batch.column(c).to_pylist() for c in ("m1", "key", "own"))):
                if keys and key == keys[-1]:  # the same set from another task
                    continue
                h = _unpacked(own)
                if m1 != least or len(sets) == MEMBERS or held + len(h) > TOKENS:
                    close()
                least, held = m1, held + len(h)
                keys.append(key)
                sets.append(h)
            yield out()
        close()
        yield out()

    n = parallelism(docs.sparkSession)
    dealt = _sets(docs, shared, words).repartition(n, "deal").sortWithinPartitions("m1", "m2", "m3", "key")
    return dealt.mapInArrow(lean(of), GROUPS)


def _groups_of(batch: pa.RecordBatch) -> Iterator[Group]:
    for row in zip(*(batch.column(c).to_pylist() for c in ("gid", "sizes", "tokens", "bits", "local"))):
        yield Group.stored(*row)


def fronts(group: Group, weight: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """token, node, lo, hi, left: for each node (members that links within the group join) the tokens of its members' fronts, the sizes of those who have it there, and the most that they can share from it on."""
    order = np.lexsort((group.tokens, weight[0][_cells(group.tokens)]))
    tokens, parts = group.tokens[order], []
    # Of sets that are alike, one of the first size - least + 1 tokens of both is common.
    front = group.sizes - -(-percent * group.sizes // 100) + 1
    place = np.cumsum(group.part(order), axis=0, dtype=np.int64) if group.bits is not None else np.arange(1, front[0] + 1)[:, None]
    has = group.part(order).astype(bool) if group.bits is not None else np.ones(place.shape, bool)
    has &= place <= front
    for label in np.unique(group.local):
        own = np.flatnonzero(group.local == label)
        at = np.flatnonzero(has[:, own].any(axis=1))
        inside, size = has[at][:, own], group.sizes[own]
        lo = np.where(inside, size, np.iinfo(np.int32).max).min(axis=1)
        hi = np.where(inside, size, 0).max(axis=1)
        left = np.where(inside, size - place[at][:, own] + 1, 0).max(axis=1)
        parts.append((tokens[at], np.full(len(at), group.gid << 6 | int(label)), lo, hi, left))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _dealt(token, node, lo, hi, left, weight: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """The postings with their bucket's key. Those of a hot token go to buckets of its size classes and, in these, of pairs of blocks.

    Sizes of alike sets are in the same class or in neighbouring ones, so each goes to the buckets of its classes and of
    the next one; any two of a class meet in one pair of blocks at least.
    """
    salts = _salts(weight[1][_cells(token)], HOT)
    hot = np.flatnonzero(salts > 1)
    key = token.copy()
    if not len(hot):
        return key, node, lo, hi, left
    step = -np.log(percent / 100)
    first, last = (np.floor(np.log(x[hot]) / step + 1e-9).astype(np.int64) for x in (lo, hi))
    run, nth = segments(last - first + 2)
    at, size_class = hot[run], (first[run] + nth)
    own = (_mixed(node[at].astype(np.uint64)) % salts[at].astype(np.uint64)).astype(np.int64)
    run, other = segments(salts[at])
    at, size_class, own = at[run], size_class[run], own[run]
    block = np.minimum(own, other) * 1_000_003 + np.maximum(own, other)
    parted = _mixed(token[at] ^ _mixed(size_class.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + block.astype(np.uint64)))
    cold = np.flatnonzero(salts == 1)
    return np.concatenate((key[cold], parted)), *(np.concatenate((x[cold], x[at])) for x in (node, lo, hi, left))


def postings(groups: DataFrame, weight: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """The fronts of all groups, as rows for the buckets where they meet."""
    shared = groups.sparkSession.sparkContext.broadcast(weight)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fronts(g, shared.value, percent) for g in _groups_of(batch)]
            if parts:
                key, node, lo, hi, left = _dealt(*(np.concatenate(x) for x in zip(*parts)), shared.value, percent)
                for i in range(0, len(key), POSTINGS):
                    s = slice(i, i + POSTINGS)
                    yield pa.RecordBatch.from_arrays([pa.array(key[s].view(np.int64)), pa.array(node[s]), *(pa.array(x[s].astype(np.int32)) for x in (lo, hi, left)), pa.array(np.zeros(len(key[s]), bool))], ["key", "node", "lo", "hi", "left", "asked"])

    return groups.select("gid", "sizes", "tokens", "bits", "local").mapInArrow(lean(of), POSTING)


def _runs(*by: np.ndarray) -> np.ndarray:
    """True where a run of equal values of all of `by` starts."""
    new = np.zeros(len(by[0]), bool)
    new[:1] = True
    for x in by:
        new[1:] |= x[1:] != x[:-1]
    return new


def _meet(key, node, lo, hi, left, asked, root, direct: int, percent: int):
    """Pairs of groups to judge, of whole buckets in order of key, and the postings of buckets that aren't done.

    A posting that asks is held against all of its bucket that have other roots and sizes near enough. Those of the
    bucket's largest root needn't ask: when all others did, only nodes that are joined already are left. In a round so
    many ask that a bucket gives about SHARE * direct pairs; those nearest to their front go first.
    """
    many = np.diff(np.append(np.flatnonzero(_runs(key)), len(key)))
    keep = np.repeat(many > 1, many)
    key, node, lo, hi, left, asked, root = (x[keep] for x in (key, node, lo, hi, left, asked, root))
    n = len(key)
    start = np.flatnonzero(_runs(key))
    many = np.diff(np.append(start, n))
    bucket = np.repeat(np.arange(len(start)), many)
    # The largest root of each bucket.
    by = np.lexsort((root, bucket))
    first = np.flatnonzero(_runs(bucket[by], root[by]))
    length = np.diff(np.append(first, n))
    of = bucket[by][first]
    top = np.lexsort((length, of))
    main = root[by][first][top[np.append(np.flatnonzero(_runs(of[top]))[1:] - 1, len(top) - 1)]] if n else root
    ask = np.flatnonzero(~asked & (root != main[bucket])) if n else np.empty(0, np.int64)
    ask = ask[np.lexsort((node[ask], -left[ask] / hi[ask], bucket[ask]))]
    waiting = np.bincount(bucket[ask], minlength=len(start))
    nth = np.arange(len(ask)) - (np.cumsum(waiting) - waiting)[bucket[ask]]
    may = np.maximum(1, SHARE * direct // np.maximum(many, 1))
    ask = ask[nth < may[bucket[ask]]]
    open_ = (waiting > may)[bucket]
    asked = asked.copy()
    asked[ask] = True
    found = []
    ends = np.cumsum(many[bucket[ask]])
    i = 0
    while i < len(ask):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        run, at = segments(many[bucket[ask[i:j]]])
        a, b = ask[i:j][run], start[bucket[ask[i:j]]][run] + at
        both = lo[a].astype(np.int64) + lo[b]
        ok = (root[a] != root[b]) & (node[a] >> 6 != node[b] >> 6)
        ok &= (percent * lo[a].astype(np.int64) <= 100 * hi[b].astype(np.int64)) & (percent * lo[b].astype(np.int64) <= 100 * hi[a].astype(np.int64))
        # The most that both can share if this is the first token they share.
        ok &= np.minimum(left[a], left[b]).astype(np.int64) * (100 + percent) >= percent * both
        ga, gb = node[a[ok]] >> 6, node[b[ok]] >> 6
        found.append(np.unique(np.stack((np.minimum(ga, gb), np.maximum(ga, gb))), axis=1))
        i = j
    pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return pairs, tuple(x[open_] for x in (key, node, lo, hi, left, asked))


def _candidates(entries: DataFrame, direct: int, percent: int) -> DataFrame:
    """a, b of pairs of groups to judge; and, with b null, the postings of buckets that need another round."""
    names = ["a", "b", "key", "lo", "hi", "left", "asked"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts):
            pairs, (key, node, lo, hi, left, asked) = _meet(*(np.concatenate(x) for x in zip(*parts)), direct, percent)
            p, m = pairs.shape[1], len(node)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(p, pa.int64()), *[pa.nulls(p, pa.int32())] * 3, pa.nulls(p, pa.bool_())], names)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(m, pa.int64()), *(pa.array(x) for x in (key, lo, hi, left, asked))], names)

        parts: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if rows > POSTINGS and (cut or parts[-1][0][-1] != cols[0][0]):  # up to the last whole bucket
                parts.append(tuple(x[:cut] for x in cols))
                yield from found(parts)
                parts, rows, cols = [], 0, tuple(x[cut:] for x in cols)
            parts.append(cols)
            rows += len(cols[0])
        if parts:
            yield from found(parts)

    sent = entries.repartition(parallelism(entries.sparkSession), "key").sortWithinPartitions("key")
    return sent.mapInArrow(lean(compare), "a long, b long, key long, lo int, hi int, left int, asked boolean")


def judged(groups: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: links between nodes of groups(durable), for pairs(a, b; durable, distinct) of groups.

    The group of more pairs is sent once to each task that judges some of them; the other comes with each pair.
    """
    spark = groups.sparkSession
    often = durable(pairs.select(F.explode(F.array("a", "b")).alias("gid")).groupBy("gid").agg(F.count("*").alias("many")))
    own = groups.join(few(often), "gid").select("gid", F.struct("sizes", "tokens", "bits", "local").alias("own"))
    both = pairs.join(often.toDF("a", "na"), "a").join(often.toDF("b", "nb"), "b")
    first = F.col("na") >= F.col("nb")
    salts = F.ceil(F.greatest("na", "nb") / PER_HUB).cast("int")
    turned = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("gid"), salts.alias("salts"))
    turned = turned.withColumn("salt", F.pmod(F.xxhash64("gid"), F.col("salts")).cast("int"))
    hubs = turned.groupBy("hub").agg(F.max("salts").alias("salts")).select(F.col("hub").alias("gid"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hubs = hubs.join(own, "gid").select(F.col("gid").alias("hub"), "salt", F.lit(None).cast("long").alias("gid"), "own")
    rows = hubs.unionByName(turned.join(own, "gid").select("hub", "salt", "gid", "own"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in batches:
            a, b = [], []
            for at, gid, own in zip(*(batch.column(c).to_pylist() for c in ("hub", "gid", "own"))):
                group = Group.stored(at if gid is None else gid, **own)
                if gid is None:
                    hub = group
                else:
                    for x, y in group.links(hub, percent):
                        a.append(x)
                        b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    n = parallelism(spark)
    with small_batches(spark):
        return durable(rows.repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("gid").asc_nulls_first()).mapInArrow(lean(judge), "a long, b long"))


def joined(groups: DataFrame, weight: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """node, root for every node of groups(durable) that isn't the smallest of its component.

    Rounds go on until every pair that meets is judged or joined already; each keeps its state in the shared folder.
    """
    entries, found_roots, direct = postings(groups, weight, percent), None, DIRECT
    columns = ["key", "node", "lo", "hi", "left", "asked"]
    while True:
        if found_roots is None:
            named = entries.select(*columns, F.col("node").alias("root"))
        else:
            named = entries.join(few(found_roots), "node", "left").select(*columns, F.coalesce("root", "node").alias("root"))
        found = durable(_candidates(named, direct, percent))
        links = judged(groups, durable(found.where("b is not null").select("a", "b").distinct()), percent)
        found_roots = roots(links if found_roots is None else links.unionByName(found_roots.toDF("a", "b")))
        entries = found.where("b is null").select("key", F.col("a").alias("node"), "lo", "hi", "left", "asked")
        if entries.isEmpty():
            return found_roots
        direct *= GROWTH


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text).

    Two documents are linked if `percent` of their sets' union is in both; the component_id is the smallest doc_id that
    links reach. Equal sets are one member, whatever their number. Null texts and texts without words have the empty set
    and are linked with nothing. Null doc_ids count only where nothing else is there, repeated rows stay, an empty table
    gives an empty result, texts are taken whole, further columns are not read. Sets are told apart by 128-bit digests of
    64-bit hashes of shingles; what two sets share is counted by 48 bits of these.
    """
    docs = docs.select("doc_id", "text")
    with freeing(docs.sparkSession), small_batches(docs.sparkSession, 1000):
        survey = durable(surveyed(docs, words))
        weight = counts(survey)
        groups = durable(grouped(docs, weight, words, percent))
        linked = joined(groups, weight, percent)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = [], []
            for gid, own, local in zip(*(batch.column(c).to_pylist() for c in ("gid", "keys", "local"))):
                nodes += [gid << 6 | x for x in local]
                keys += [own[i : i + 16] for i in range(0, len(own), 16)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.binary())], ["node", "key"])

    rows = survey.where("slice is null").select("doc_id", "n_shingles", "key")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("low"))
    placed = groups.select("gid", "keys", "local").mapInArrow(lean(members), "node long, key binary")
    placed = placed.join(few(linked), "node", "left").select("key", F.coalesce("root", "node").alias("root")).join(classes, "key")
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    by_key = durable(placed.join(least, "root").select(F.col("key").alias("key_"), "component_id"))
    out = rows.join(by_key, F.col("key") == F.col("key_"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark, documents: DataFrame) -> DataFrame:
    return components(documents)
