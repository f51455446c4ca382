"""Byte-level BPE by merge replay over a batch's distinct words.

All distinct words that a batch brings are merged together: an inverted index leads from a pair's rank to the places
where that pair stands; ranks are replayed in order, each over all its places at once, and only the two neighbours of
a merged place get new index entries. A rank is replayed at the first place of a word, then at its next, so each word
sees the very order of merges that encoding it alone would take. A long word has an index of its own, a heap of ranks and places,
so that many places of one rank in it don't take a round each.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import extended, keep, lean, texts, without

NONE = np.iinfo(np.int32).max
#: Pieces of text whose ids a worker remembers between batches, in each of two generations; those that the newer one
#: hasn't met when it is full are forgotten, which costs time only.
REMEMBERED = 100_000
#: Characters of new text that are replayed together, and bytes of text whose ids are held at a time.
PIECE = 4_000_000
#: Bytes from which on a word is replayed by itself; the ids are the same either way.
LONG = 256


class Ranks:
    """A vocabulary: ids of byte strings, and of each adjacent pair of ids the id of the two joined."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {v: k for k, v in self.ids.items()}
        self.byte = np.array([self.ids[bytes([i])] for i in range(256)], np.int64)
        pairs = []
        for token, rank in self.ids.items():
            for i in range(1, len(token)):
                a, b = self.ids.get(token[:i]), self.ids.get(token[i:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, rank))
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pairs = np.append(table[:, 0], np.iinfo(np.int64).max)
        self.merged = np.append(table[:, 1], NONE).astype(np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a << 32 | b
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.merged[at], NONE)

    def encode_words(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """The ids of the words (not empty) end to end, and where each word's end. A word that is a token is that token."""
        whole = list(map(self.ids.get, words))
        todo = [i for i, x in enumerate(whole) if x is None and len(words[i]) < LONG]
        long = {i: self._replay_one(w) for i, (x, w) in enumerate(zip(whole, words)) if x is None and len(w) >= LONG}
        ids, many = self._replay([words[i] for i in todo])
        size = np.ones(len(words), np.int64)
        size[todo] = many
        for i, own in long.items():
            size[i] = len(own)
        end = np.cumsum(size)
        flat = np.empty(int(size.sum()), np.int64)
        kind = np.zeros(len(words), np.int8)
        kind[todo], kind[list(long)] = 1, 2
        kind = np.repeat(kind, size)
        flat[kind == 0] = [x for x in whole if x is not None]
        flat[kind == 1] = ids
        for i, own in long.items():
            flat[end[i] - len(own) : end[i]] = own
        return flat.tolist(), end.tolist()

    @cached_property
    def joined(self) -> dict[int, int]:
        return dict(zip(self.pairs[:-1].tolist(), self.merged[:-1].tolist()))

    def _replay_one(self, word: bytes) -> list[int]:
        """One word's ids, in time that grows with its length and the logarithm of that."""
        joined, n = self.joined.get, len(word)
        token = self.byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [joined(a << 32 | b, NONE) for a, b in zip(token, token[1:])] + [NONE]
        heap = [(r, i) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            gone = after[i]
            nxt = after[i] = after[gone]
            token[i], rank[gone], rank[i] = r, NONE, NONE
            if nxt < n:
                before[nxt] = i
                if (x := joined(r << 32 | token[nxt])) is not None:
                    rank[i] = x
                    heapq.heappush(heap, (x, i))
            if (left := before[i]) >= 0:
                rank[left] = x = joined(token[left] << 32 | r, NONE)
                if x != NONE:
                    heapq.heappush(heap, (x, left))
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return out

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words end to end, and how many each has."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        n = int(size.sum())
        end = np.cumsum(size)
        token = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[end - 1], before[end - size] = -1, -1
        rank = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.rank(token[inner], token[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            places = places[rank[places] != NONE]
            if not len(places):
                return
            ranks = rank[places]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            for r, own in zip(ranks[np.concatenate(([0], cut))].tolist(), np.split(places, cut)):
                if r not in index:
                    index[r] = [own]
                    heapq.heappush(heap, r)
                else:
                    index[r].append(own)

        enter(inner)
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                first = np.append(True, np.diff(word[at]) != 0)
                if not first.all():
                    index[r] = [at[~first]]
                    heapq.heappush(heap, r)
                    at = at[first]
            gone = after[at]
            nxt = after[gone]
            token[at] = r
            rank[gone] = NONE
            after[at] = nxt
            has = nxt >= 0
            rank[at] = NONE
            right = at[has]
            before[nxt[has]] = right
            rank[right] = self.rank(token[right], token[nxt[has]])
            left = before[at]
            left = left[left >= 0]
            rank[left] = self.rank(token[left], token[after[left]])
            enter(np.concatenate((left, right)))
        alive = self._reached(after, end - size, n)
        return token[alive], np.bincount(word[alive], minlength=len(words))

    @staticmethod
    def _reached(after: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        """The places that are left: those that each word's first one leads to."""
        seen = np.zeros(n, bool)
        at = start
        while len(at):
            seen[at] = True
            at = after[at]
            at = at[at >= 0]
        return seen


@contextmanager
def _no_collection():
    """Nothing here makes cycles, and looking for them would scan all that is remembered again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Encoder:
    """Texts to ids and back, for one vocabulary and one pattern; keeps what it has seen."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = Ranks(path)
        self.pattern = regex.compile(pattern)
        self.decimal = {i: b"%d" % i for i in self.ranks.bytes}
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
        #: White space besides space and newline, and what else keeps a space from starting a match.
        self.odd = [*regex.findall(r"[^\S \n]", everything), "  ", " \n", "\n "]
        self.seen: dict[str, tuple[bytes, int, bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, int, bytes, bytes]] = {}

    def parts(self, text: str) -> list[str]:
        """The text in pieces that matches don't cross.

        A space between two characters that are no white space starts a match, as the pattern takes a space only first.
        """
        if text[-1:] == " " or any(x in text for x in self.odd):
            return self.pattern.findall(text)
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]] if head else [" " + x for x in rest]

    def learn(self, parts: set[str]) -> None:
        """Encode these pieces together."""
        index: dict[str, int] = {}
        matches = []
        for part in parts:
            if part in self.older:
                self.seen[part] = self.older[part]
            else:
                matches.append((part, [index.setdefault(m, len(index)) for m in self.pattern.findall(part)]))
        flat, ends = self.ranks.encode_words([m.encode("utf-8", "surrogatepass") for m in index])
        decimal, token = self.decimal.__getitem__, self.ranks.bytes.__getitem__
        words, i = [], 0
        for j in ends:
            ids = flat[i:j]
            words.append((b",".join(map(decimal, ids)), j - i, b"".join(map(token, ids)), array("i", ids).tobytes()))
            i = j
        for part, own in matches:
            if len(own) == 1:
                self.seen[part] = words[own[0]]
            else:
                a, b, c, d = zip(*[words[k] for k in own])
                self.seen[part] = (b",".join(a), sum(b), b"".join(c), b"".join(d))

    def encode(self, items: list[str]) -> Iterator[list[tuple[bytes, int, bytes, bytes]]]:
        """Per text its pieces' ids (decimal, joined by commas), their number, the bytes that they decode to, and the ids as 32-bit numbers."""
        i = 0
        while i < len(items):
            if len(self.seen) > REMEMBERED:
                self.seen, self.older = {}, self.seen
            block, new, size = [], set(), 0
            while i < len(items) and size < PIECE and len(self.seen) + len(new) < 2 * REMEMBERED:
                block.append(parts := self.parts(items[i]))
                new.update(parts)
                size += len(items[i])
                i += 1
            with _no_collection():
                self.learn(new - self.seen.keys())
            get = self.seen.__getitem__
            for parts in block:
                yield list(map(get, parts))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    keep(__name__, encoder.cache_clear)
    return Encoder(path, pattern)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of PIECE bytes of text at most; a longer text is one of its own."""
    i = size = 0
    for j, n in enumerate(pc.binary_length(batch.column("text").cast(pa.large_binary())).to_pylist()):
        if size and size + (n or 0) > PIECE:
            yield batch.slice(i, j - i)
            i, size = j, 0
        size += n or 0
    if i < batch.num_rows:
        yield batch.slice(i)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with ids (array of int), n_tokens, ids_sha256 and decoded_sha256 of the whole text; see query for the contract.

    Null and empty texts have no ids. Columns of these names are replaced, others pass through. Each row is worked on by
    itself but for what a worker remembers, so lost executors cost their tasks only. path: the rank file on each
    executor; unset, the installed public vocabulary.
    """
    docs = without(docs, "ids", "n_tokens", "ids_sha256", "decoded_sha256")
    return docs.mapInArrow(lean(_encoded(path, pattern, True)), extended(docs, "ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """encode() without the ids themselves."""
    docs = without(docs, "n_tokens", "ids_sha256", "decoded_sha256")
    return docs.mapInArrow(lean(_encoded(path, pattern, False)), extended(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def _encoded(path: str | None, pattern: str | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        enc = encoder(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
        for batch in chain.from_iterable(map(_slices, batches)):
            ids, many, digest, decoded = [], [], [], []
            for parts in enc.encode(texts(batch.column("text"))):
                joined = b",".join([x[0] for x in parts])
                if with_ids:
                    ids.append(b"".join([x[3] for x in parts]))
                many.append(sum([x[1] for x in parts]))
                digest.append(hashlib.sha256(joined).hexdigest())
                decoded.append(hashlib.sha256(b"".join([x[2] for x in parts])).hexdigest())
            arrays = []
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum(many))).astype(np.int32)
                arrays = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))]
            cols = arrays + [pa.array(many, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
            names = ["ids"] * with_ids + ["n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *names])

    return run


def query(spark, documents: DataFrame) -> DataFrame:
    return digests(documents.select("doc_id", "text")).drop("text")
