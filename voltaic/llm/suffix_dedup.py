"""Exact removal of repeated byte strings, by blockwise suffix sorting with difference covers.

A window is WINDOW bytes of a document. Four steps find for every window the smallest doc_id in which it starts:

1. Cover samples: positions whose remainder modulo COVER lies in a difference cover. Any two equal windows have a
   shift below COVER at which both have a sample, so windows without a sample that recurs elsewhere are unique. Samples
   are hashed; buckets of hashes answer one bit per sample.
2. The other windows go, as runs of text, to suffix buckets, chosen by the least hash of a window's substrings.
3. One bucket at a time is sorted: suffixes by their first 7 bytes, ties by precomputed ranks of the bucket's own cover
   positions (difference cover modulo 7), so long common prefixes are never compared byte by byte and memory stays that
   of a bucket. Neighbours whose common prefix reaches WINDOW are equal windows. Each is answered by a bit.
4. Removed windows become removed bytes.

Text crosses the network once, as chunks; chunks send each string once, whatever its number of copies in them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, extended, lean, lean_group, segments, without

WINDOW = 50
#: Perfect difference sets modulo 31 and 7.
COVER, COVER_SET = 31, (1, 5, 11, 24, 25, 27)
SMALL, SMALL_SET = 7, (1, 2, 4)
#: Bytes that a sample hashes: a window holds them at any shift below COVER.
SAMPLE = WINDOW - COVER + 1
#: Bytes of the substrings whose least hash names a window's bucket.
GRAM = 16
#: Bytes of text in a chunk; a longer document is a chunk of its own, worked on in blocks of so many bytes.
CHUNK = 3_000_000
#: Samples, and bytes of window runs, that a bucket is meant to hold.
SAMPLES, RUNS = 3_000_000, 6_000_000
NULL_ID = np.iinfo(np.int64).max
U = np.uint64
#: Low bits that sample hashes leave free, for the place of a sample in its chunk.
FREE = 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0x9FB21C651E98DF25)
    return x ^ (x >> U(32))


def _words(raw: np.ndarray, kind: str = ">u8") -> np.ndarray:
    """The 8 bytes at each position as a number, first byte first; zeros follow the end."""
    padded = np.concatenate((raw, np.zeros(64, np.uint8)))
    return np.ndarray((len(raw) + 57,), kind, padded, 0, (1,))


def _load(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return words[at].astype(np.uint64, copy=False)


def _squeezed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unsqueezed(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype)


def _index(n: int) -> type:
    """The least type that holds places in n bytes and the zeros behind them."""
    return np.int32 if n < 2**31 - 1024 else np.int64


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of numbers below 2 ** bits, and where in it another number begins.

    Number and place are sorted as one if they fit into 64 bits, which takes a fifth of the time of an indirect sort.
    """
    own = len(key).bit_length()
    if bits + own > 64:
        order = np.argsort(key)
        key = key[order]
    else:
        key = key << U(own)
        for i in range(0, len(key), 1 << 18):
            part = key[i : i + (1 << 18)]
            part |= np.arange(i, i + len(part), dtype=np.uint64)
        key.sort()
        order = np.empty(len(key), _index(len(key)))
        np.bitwise_and(key, U((1 << own) - 1), out=order, casting="unsafe")
        key >>= U(own)
    return order, np.append(True, key[1:] != key[:-1])[: len(key)]


def _ranked(key: np.ndarray, bits: int) -> np.ndarray:
    """The number of distinct smaller ones, for each of numbers below 2 ** bits."""
    order, new = _sorted(key, bits)
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(new) - 1
    return rank


def _start_key(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers in the order of the SMALL bytes at each place, and their bits: the rank of five bytes before two."""
    word = _load(words, at)
    five = _ranked(word >> U(24), 40)
    bits = int(five.max(initial=0)).bit_length()
    five <<= U(16)
    five |= word >> U(8) & U(0xFFFF)
    return five, bits + 16


class Chunk:
    """The documents of a chunk: text end to end, where each starts, and its id."""

    def __init__(self, payload: bytes, doc_id: str, text: str):
        self.table = pa.ipc.open_stream(payload).read_all().combine_chunks()
        own = [b"" if x is None else x for x in self.table.column(text).cast(pa.large_binary()).to_pylist()]
        self.raw = np.frombuffer(b"".join(own), np.uint8)
        self.words = _words(self.raw, "<u8")  # for hashes only
        self.size = np.fromiter(map(len, own), np.int64, len(own))
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.id = np.array([NULL_ID if x is None else x for x in self.table.column(doc_id).to_pylist()], np.int64)

    def doc(self, at: np.ndarray) -> np.ndarray:
        """The documents of ascending positions."""
        return np.repeat(np.arange(len(self.end)), np.diff(np.searchsorted(at, self.end), prepend=0))

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the cover samples, their hashes and documents."""
        n = len(self.raw)
        places, hashes = [], []
        for lo in range(0, n, COVER * 100_000):
            many = min(100_000, (n - lo) // COVER + 1)
            at = (lo + np.arange(many)[:, None] * COVER + np.array(COVER_SET)).ravel()
            h = np.empty((many, len(COVER_SET)), np.uint64)
            for i, c in enumerate(COVER_SET):  # words a period apart are a slice, no look-up
                x, y, z = (self.words[lo + c + step :: COVER][:many].astype(np.uint64) for step in (0, 8, SAMPLE - 8))
                h[:, i] = _mix(_mix(x) ^ _mix(y + U(0x9E3779B97F4A7C15)) * U(3) ^ _mix(z + U(0xC2B2AE3D27D4EB4F)) * U(5)) >> U(FREE)
            at = at[: np.searchsorted(at, n - SAMPLE, "right")]
            keep = at + SAMPLE <= self.end[self.doc(at)]
            places.append(at[keep])
            hashes.append(h.ravel()[: len(at)][keep])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.concatenate(places)
        return at, np.concatenate(hashes), self.doc(at)

    def distinct_samples(self):
        """at, the order of their hashes, how many samples each distinct hash has, these hashes in order, and which of them two documents have here."""
        at, h, doc = self.samples()
        order, new = _sorted(h, 64 - FREE)
        h, doc = h[order], doc[order]
        first = np.flatnonzero(new)
        shared = np.zeros(len(first), bool)
        shared[(np.cumsum(new) - 1)[1:][(doc[1:] != doc[:-1]) & ~new[1:]]] = True
        return at, order, np.diff(first, append=len(h)), h[first] << U(FREE), shared

    def candidates(self, at: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of the samples at these ascending positions at a shift below COVER."""
        doc = self.doc(at)
        # No window starts in the last WINDOW - 1 bytes of a document.
        low, high = np.maximum(at - COVER + 1, self.start[doc]), np.minimum(at, self.end[doc] - WINDOW)
        some = low <= high
        low, high = low[some], high[some]
        new = np.append(True, low[1:] > high[:-1])[: len(low)]
        low, high = low[new], high[np.append(new[1:], True)[: len(new)]]
        run, place = segments(high - low + 1)
        return low[run] + place


def _runs(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of one bucket hash: index of the first window in at, number, hash."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    new = np.append(True, np.diff(at) != 1)
    first = np.flatnonzero(new)
    many = np.diff(first, append=len(at))
    span = WINDOW - GRAM + 1  # substrings of a window
    run, place = segments(many + span - 1)
    gram = at[first][run] + place
    h = _mix(_load(words, gram) ^ _mix(_load(words, gram + 8)))
    for step in (1, 2, 4, 8, 16):
        h[:-step] = np.minimum(h[:-step], h[step:])
    h[: -(span - 32)] = np.minimum(h[: -(span - 32)], h[span - 32 :])
    key = h[place < many[run]]
    new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(first, append=len(at)), _mix(key[first])


def _span_hash(words: np.ndarray, start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """A hash of the text of each run of so many windows from start."""
    run, place = segments(many)
    at = start[run] + place
    total = np.add.reduceat(_mix(_load(words, at) + place.astype(np.uint64) * U(0x9E3779B97F4A7C15)), np.cumsum(many) - many) if len(many) else np.empty(0, np.uint64)
    last = start + many - 1
    for i, step in enumerate((8, 16, 24, 32, 40, WINDOW - 8)):
        total = _mix(total + U(i)) ^ _load(words, last + step)
    return _mix(total + many.astype(np.uint64))


class Windows:
    """A chunk's candidate windows, in runs; equal runs are sent once, for the smallest doc_id."""

    def __init__(self, chunk: Chunk, shared_at: np.ndarray):
        self.at = chunk.candidates(shared_at)
        self.first, self.many, key = _runs(chunk.words, self.at)
        self.id = chunk.id[chunk.doc(self.at[self.first])] if len(self.first) else np.empty(0, np.int64)
        span = np.concatenate([_span_hash(chunk.words, self.at[self.first[i : i + 100_000]], self.many[i : i + 100_000]) for i in range(0, len(self.first), 100_000)] or [np.empty(0, np.uint64)])
        order = np.lexsort((self.id, span))
        head = np.append(True, np.diff(span[order]) != 0) if len(order) else np.empty(0, bool)
        self.sent = order[head]  # runs that are sent
        self.of = np.empty(len(order), np.int64)  # each run's place among the sent
        self.of[order] = np.cumsum(head) - 1
        self.bucket_hash = key[self.sent]

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The order in which sent runs go, and the bucket of each."""
        bucket = (self.bucket_hash % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order]

    def removed(self, answers: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Windows that start in a smaller doc_id. answers: a truth value per window of the sent runs in this order."""
        many = self.many[self.sent]
        start = np.empty(len(order), np.int64)
        start[order] = np.cumsum(many[order]) - many[order]
        run, place = segments(self.many)
        own = self.of[run]
        return answers[start[own] + place] | (self.id > self.id[self.sent][self.of])[run]


def pack(docs: DataFrame, text: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """chunk, n_bytes, payload: all columns of some rows as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []
        size = 0

        def full() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "n_bytes", "payload"])

        for batch in batches:
            sizes = [len(x or b"") for x in batch.column(text).cast(pa.large_binary()).to_pylist()]
            i = 0
            for j, n in enumerate(sizes):
                if size and size + n > chunk_bytes:
                    if j > i:
                        held.append(batch.slice(i, j - i))
                    yield full()
                    held, size, i, number = [], 0, j, number + 1
                size += n
            if len(sizes) > i:
                held.append(batch.slice(i))
        if held:
            yield full()

    return docs.mapInArrow(lean(run), "chunk long, n_bytes long, payload binary")


def _samples_sent(buckets: int, doc_id: str, text: str):
    shift = U(64 - buckets.bit_length() + 1) if buckets > 1 else U(63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload").to_pylist()):
                distinct = Chunk(payload, doc_id, text).distinct_samples()[3]
                rows = [(b, distinct[i:j]) for b, (i, j) in _present(distinct, buckets, shift).items()]
                blobs = []
                for _, h in rows:
                    low = _low(h, shift)
                    gaps = np.diff(low, prepend=np.uint32(0))
                    blobs.append(_squeezed(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T)))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "hashes"])

    return run


def _present(distinct: np.ndarray, buckets: int, shift) -> dict[int, tuple[int, int]]:
    """The buckets that ascending hashes fall into, and where in them each begins and ends; the others take no time."""
    bucket = (distinct >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(distinct), np.int64)
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    return dict(zip(bucket[cut].tolist(), zip(cut.tolist(), np.append(cut[1:], len(bucket)).tolist())))


def _low(h: np.ndarray, shift) -> np.ndarray:
    """The 32 bits of a hash below those that name its bucket."""
    return (h >> (shift - U(32)) & U(0xFFFFFFFF)).astype(np.uint32)


def _samples_answered(table: pa.Table) -> pa.Table:
    """For each chunk's samples of a bucket, in order: does another chunk have it?"""
    hashes = []
    for x in table.column("hashes").to_pylist():
        planes = _unsqueezed(x, np.uint8).reshape(4, -1)
        hashes.append(np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32)[:, 0], dtype=np.uint32))
    size = np.array([len(x) for x in hashes])
    key = np.concatenate(hashes).astype(np.uint64) << U(32) | np.arange(size.sum(), dtype=np.uint64)
    key.sort()
    low = key >> U(32)
    same = np.append(False, low[1:] == low[:-1])
    same[:-1] |= same[1:]
    answer = np.zeros(len(key), bool)
    answer[(key & U(0xFFFFFFFF)).astype(np.int64)] = same
    bits = [np.packbits(x).tobytes() for x in np.split(answer, np.cumsum(size)[:-1])]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _windows(chunk: Chunk, answers: list[dict] | None, buckets: int) -> Windows:
    """The chunk's candidate windows, from the answers for its samples."""
    shift = U(64 - buckets.bit_length() + 1) if buckets > 1 else U(63)
    at, order, many, distinct, shared = chunk.distinct_samples()
    cut = _present(distinct, buckets, shift)
    for x in answers or ():
        lo, hi = cut[x["bucket"]]
        shared[lo:hi] |= np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=hi - lo).view(bool)
    found = np.empty(len(at), bool)
    found[order] = np.repeat(shared, many)
    return Windows(chunk, at[found])


def _runs_sent(sample_buckets: int, buckets: int, doc_id: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload, answers in zip(*(batch.column(c).to_pylist() for c in ("chunk", "payload", "answers"))):
                chunk = Chunk(payload, doc_id, text)
                w = _windows(chunk, answers, sample_buckets)
                order, bucket = w.by_bucket(buckets)
                cut = np.flatnonzero(np.append(True, np.diff(bucket) != 0)) if len(bucket) else np.empty(0, np.int64)
                out = []
                for i, j in zip(cut.tolist(), np.append(cut[1:], len(bucket)).tolist()):
                    runs = w.sent[order[i:j]]
                    many = w.many[runs]
                    piece, place = segments(many + WINDOW - 1)
                    body = chunk.raw[w.at[w.first[runs]][piece] + place]
                    out.append((int(bucket[i]), _squeezed(body), _squeezed(many.astype(np.int32)), _squeezed(w.id[runs])))
                cols = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([number] * len(out), pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["bucket", "chunk", "body", "many", "ids"])

    return run


def cover_ranks(raw: np.ndarray, words: np.ndarray, zeros: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the 56 bytes from each cover position (modulo SMALL), and where a position's rank stands."""
    n = len(raw)
    place = np.zeros(n + 8 * SMALL + 1, _index(n))  # 0: nothing but zeros follow
    at = (np.arange(0, n, SMALL)[:, None] + np.array(SMALL_SET)).ravel()
    at = at[at < n]
    if not zeros:  # of padding, only zeros matter
        at = at[_load(words, at) >> U(8) > 0]
    place[at] = np.arange(1, len(at) + 1)
    key, bits = _start_key(words, at)
    rank, have = np.append(U(0), _ranked(key, bits) + U(key.min(initial=1) > 0)), SMALL
    while have < 8 * SMALL:
        bits = int(rank.max()).bit_length()
        steps = (have, 2 * have) if 3 * bits + len(rank).bit_length() <= 64 and 2 * have < 8 * SMALL else (have,)
        key = rank.copy()
        for step in steps:
            key[1:] = key[1:] << U(bits) | rank[place[at + step]]
        rank, have = _ranked(key, bits * (len(steps) + 1)), have * (len(steps) + 1)
    return rank.astype(_index(n)), place


def _shifts() -> np.ndarray:
    """For two remainders modulo SMALL the shift that takes both into the cover."""
    return np.array([[next(k for k in range(SMALL) if (a + k) % SMALL in SMALL_SET and (b + k) % SMALL in SMALL_SET) for b in range(SMALL)] for a in range(SMALL)])


def sort_suffixes(raw: np.ndarray, at: np.ndarray, zeros: bool = True) -> np.ndarray:
    """at in the order of the suffixes there, as far as 50 bytes and more decide; raw ends in, and texts are parted by, 56 zeros.
    zeros: texts may hold zero bytes too.

    First by SMALL bytes. Suffixes that tie are split around one of theirs, all ties at once: the shift that takes both into
    the cover is below SMALL, so the ranks there decide. Rounds end when each tie is of equal suffixes only.
    """
    words = _words(raw)
    order, new = _sorted(*_start_key(words, at))
    at = at[order]
    del order
    group = np.cumsum(new, dtype=_index(len(at))) - 1
    rank, place = cover_ranks(raw, words, zeros)
    rank = rank[place]  # by position
    del place
    shift = _shifts()
    size = np.bincount(group)
    todo = np.flatnonzero(size[group] > 1)
    label = group[todo].astype(np.int64)
    del group
    while len(todo):
        own = at[todo]
        head = np.append(True, label[1:] != label[:-1])
        first = np.flatnonzero(head)
        many = np.diff(first, append=len(todo))
        pivot = np.repeat(own[first + many // 2], many)
        k = shift[own % SMALL, pivot % SMALL]
        mine, its = rank[own + k], rank[pivot + k]
        side = (mine > its).astype(np.int64) - (mine < its)
        new = _sorted((np.repeat(np.arange(len(first)), many) * 3 + side + 1).astype(np.uint64), (3 * len(first)).bit_length())[0]
        at[todo] = own[new]
        side = side[new]
        label = np.repeat(np.arange(len(first)), many) * 3 + side + 1
        # Sides that differ from the pivot and have two or more members are split again.
        count = np.bincount(label)
        again = (side != 0) & (count[label] > 1)
        todo, label = todo[again], label[again]
    return at


def _runs_answered(table: pa.Table) -> pa.Table:
    """For each chunk's windows of a bucket, in order: does the same window start in a smaller doc_id?"""
    bodies = [_unsqueezed(x, np.uint8) for x in table.column("body").to_pylist()]
    manies = [_unsqueezed(x, np.int32) for x in table.column("many").to_pylist()]
    many = np.concatenate(manies).astype(np.int64)
    ids = np.concatenate([_unsqueezed(x, np.int64) for x in table.column("ids").to_pylist()])
    body = np.concatenate(bodies)
    start = np.cumsum(many + WINDOW - 1) - (many + WINDOW - 1)
    span = _span_hash(_words(body, "<u8"), start, many)
    distinct, of = np.unique(span, return_inverse=True)
    one = np.empty(len(distinct), np.int64)
    one[of[::-1]] = np.arange(len(of))[::-1]  # one run of each text
    least = np.full(len(distinct), NULL_ID)
    np.minimum.at(least, of, ids)
    # The distinct texts, parted by zeros.
    size = many[one] + WINDOW - 1
    gap = 8 * SMALL
    piece, place = segments(size)
    to = np.cumsum(size + gap) - (size + gap)
    raw = np.zeros(int((size + gap).sum()), np.uint8)
    raw[to[piece] + place] = body[start[one][piece] + place]
    zeros = not body.all()
    del body, bodies
    del piece, place
    run, place = segments(many[one])
    small = _index(len(raw))
    window, run = (to[run] + place).astype(small), run.astype(small)
    del place
    order = sort_suffixes(raw, window, zeros)
    words = _words(raw, "<u8")
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = True
        for step in (0, 8, 16, 24, 32, 40, WINDOW - 8):
            x = _load(words, order + step)
            same[1:] &= x[1:] == x[:-1]
    group = np.cumsum(~same, dtype=small) - 1
    back = np.empty(len(raw), small)
    back[window] = np.arange(len(window), dtype=small)
    index = back[order]  # which window each sorted suffix is
    del back, order, same, words
    low = np.full(int(group[-1]) + 1 if len(group) else 0, NULL_ID)
    np.minimum.at(low, group, least[run[index]])
    lowest = np.empty(len(window), np.int64)
    lowest[index] = low[group]
    first = np.cumsum(many[one]) - many[one]
    answers, i = [], 0
    for own in manies:
        j = i + len(own)
        run, place = segments(own)
        answers.append(np.packbits(ids[i:j][run] > lowest[first[of[i:j]][run] + place]).tobytes())
        i = j
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(answers, pa.binary())})


def _removed(chunk: Chunk, w: Windows, answers: list[dict] | None, buckets: int) -> np.ndarray:
    """Which bytes of the chunk go."""
    order, bucket = w.by_bucket(buckets)
    many = w.many[w.sent][order]
    flags = np.zeros(int(many.sum()), bool)
    ends = np.concatenate(([0], np.cumsum(many)))
    for x in answers or ():
        lo, hi = ends[np.searchsorted(bucket, x["bucket"], "left")], ends[np.searchsorted(bucket, x["bucket"], "right")]
        flags[lo:hi] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=int(hi - lo)).view(bool)
    at = w.at[w.removed(flags, order)]
    new = np.append(True, np.diff(at) > WINDOW)[: len(at)]
    mark = np.zeros(len(chunk.raw) + 1, np.int8)
    mark[at[new]] = 1
    mark[at[np.append(new[1:], True)[: len(at)]] + WINDOW] = -1
    return np.cumsum(mark[:-1], dtype=np.int8).view(bool)


REPORT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finished(sample_buckets: int, buckets: int, doc_id: str, text: str, rewrite: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, a, b in zip(*(batch.column(c).to_pylist() for c in ("payload", "answers", "found"))):
                chunk = Chunk(payload, doc_id, text)
                gone = _removed(chunk, _windows(chunk, a, sample_buckets), b, buckets)
                begins = gone & ~np.concatenate(([False], gone[:-1]))
                begins[chunk.start[chunk.size > 0]] = gone[chunk.start[chunk.size > 0]]
                total, spans = (np.append(0, np.cumsum(x, dtype=_index(len(x)))) for x in (gone, begins))
                removed, many = total[chunk.end] - total[chunk.start], spans[chunk.end] - spans[chunk.start]
                kept = [chunk.raw[s:e].tobytes() if not r else chunk.raw[s:e][~gone[s:e]].tobytes() for s, e, r in zip(chunk.start.tolist(), chunk.end.tolist(), removed.tolist())]
                report = [pa.array(chunk.size), pa.array(removed, pa.int64()), pa.array(many, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                table = chunk.table
                if rewrite:
                    old = table.column(text)
                    new = pa.array([None if not o.is_valid else k.decode("utf-8", "ignore") for o, k in zip(old, kept)], old.type)
                    table = table.set_column(table.schema.get_field_index(text), text, new)
                else:
                    table = table.drop_columns([text])
                cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
                yield pa.RecordBatch.from_arrays([*cols, *report], [*table.schema.names, *[x.split()[0] for x in REPORT.split(", ")]])

    return run


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rewrite: bool = True, chunk_bytes: int = CHUNK, samples: int = SAMPLES, run_bytes: int = RUNS) -> DataFrame:
    """docs with REPORT and, if rewrite, texts without the removed bytes; else without texts.

    A byte goes if a WINDOW-byte string over it also starts in a document of smaller doc_id; strings are those of the
    input, and never cross documents. Null texts are empty and stay null; a null doc_id is larger than all others;
    rows of one doc_id never remove from each other; parts of a character that a cut leaves are dropped from the
    rewritten text, not from the digest. Columns of REPORT are replaced, others pass through. Empty tables give empty
    results.
    """
    docs = without(docs, *[x.split()[0] for x in REPORT.split(", ")])
    chunks = durable(pack(docs, text, chunk_bytes))
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    sample_buckets = 1 << max(0, (total * len(COVER_SET) // COVER // samples).bit_length())
    buckets = max(1, total * 2 // run_bytes)
    # A row per chunk and bucket with anything in it; blobs fill up as buckets hold more than chunks.
    sent = chunks.select("chunk", "payload").mapInArrow(lean(_samples_sent(sample_buckets, doc_id, text)), "bucket int, chunk long, hashes binary")
    answered = sent.groupBy("bucket").applyInArrow(lean_group(_samples_answered), "chunk long, bucket int, bits binary")
    answers = answered.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    whole = chunks.select("chunk", "payload").join(answers.hint("shuffle_hash"), "chunk", "left")
    runs = whole.mapInArrow(lean(_runs_sent(sample_buckets, buckets, doc_id, text)), "bucket int, chunk long, body binary, many binary, ids binary")
    found = runs.groupBy("bucket").applyInArrow(lean_group(_runs_answered), "chunk long, bucket int, bits binary")
    found = found.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("found"))
    done = whole.join(found.hint("shuffle_hash"), "chunk", "left").select("payload", "answers", "found")
    kept = docs if rewrite else docs.drop(text)
    return done.mapInArrow(lean(_finished(sample_buckets, buckets, doc_id, text, rewrite)), extended(kept, REPORT))


def query(spark, documents: DataFrame) -> DataFrame:
    return deduplicate(documents.select("doc_id", "text"), rewrite=False)
