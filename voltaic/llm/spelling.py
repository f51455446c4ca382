"""Spelling variants by full neighbourhood generation: every text one edit away from a word is made and looked up.

A word's neighbourhood is all distinct texts that one deletion, one replacement or one insertion of a letter of the
observed alphabet gives. Those that are words are its near words; the join on equal texts needs no distance check.
Nearly all of a neighbourhood are no words, so a Bloom filter of the vocabulary rules them out by rolling hashes where
they are made, and only the rest are written out as texts and shuffled. What the filter lets through in error the join
drops; it never drops a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, lean, parallelism

#: Letters of a word: a run of these, of which only A-Z are lower-cased.
LETTERS = r"[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in about so many loses a letter, by its checksum.
SLIP = 199
#: Least code points and occurrences of a word; how many times the occurrences of a word its form must have.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: The filter: bits for each word, probes, and the most bits it may have (64 MB; with more words it lets more through).
BITS, PROBES, MOST_BITS = 16, 6, 1 << 29
#: Neighbours whose hashes are looked up at once.
AT_ONCE = 1 << 20
#: The base of the rolling hash (odd), and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def runs(documents: DataFrame) -> DataFrame:
    """doc_id, run: the lower-cased runs of letters of whole texts, one row for each occurrence."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS})"), F.lit(1)))
    own = documents.select("doc_id", run.alias("run"))
    # lower() is fast on ASCII and would change other letters too.
    return own.withColumn("run", F.when(F.octet_length("run") == F.char_length("run"), F.lower("run")).otherwise(F.translate("run", CAPITALS, SMALL)))


def slipped(doc_id: Column, run: Column) -> Column:
    """The run, without one letter if SLIP divides the checksum of doc_id and run; a null doc_id counts as empty text."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: what the runs of whole texts give, with the occurrences of each, counted before anything is shuffled."""
    own = runs(documents).where(F.char_length("run") >= least_length)
    own = own.select(slipped(F.col("doc_id"), F.col("run")).alias("word")).where(F.char_length("word") >= least_length)
    return own.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def alphabet(words: DataFrame) -> str:
    """The letters that occur in words, in order: as many as there are letters, whatever the number of words."""
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''").distinct()
    return "".join(sorted(r.letter for r in letters.collect()))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes spread over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _probe(h: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The place of the i-th probe of mixed hashes, in a filter of `bits` bits (a power of two)."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64)


def _codes(points: np.ndarray) -> np.ndarray:
    """A 64-bit number for each code point."""
    return _mixed(points.astype(np.uint64) * np.uint64(BASE) + np.uint64(1))


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the words of one length, and their code points, a row each; small words come in large groups."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths[lengths > 0]):
        own = np.flatnonzero(lengths == length)
        step = max(1, AT_ONCE // (256 * int(length)))
        for i in range(0, len(own), step):
            part = own[i : i + step]
            yield part, np.frombuffer("".join(words[j] for j in part).encode("utf-32-le"), np.uint32).reshape(len(part), -1)


def hashes(words: list[str]) -> np.ndarray:
    """The rolling hash of each word: its letters' numbers, times the base to the power of their places."""
    out = np.zeros(len(words), np.uint64)
    for own, points in _by_length(words):
        out[own] = (_codes(points) * _powers(points.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)
    return out


def neighbourhoods(words: list[str], letters: str, keep) -> tuple[np.ndarray, list[str]]:
    """For each distinct neighbour whose hash passes keep(): the number of its word, and the neighbour.

    Distinct without a look: of a run of equal letters the last is deleted, a letter is inserted after a run of itself
    and not within, and is replaced by others only.
    """
    own_letters = np.frombuffer(letters.encode("utf-32-le"), np.uint32)
    codes = _codes(own_letters)
    numbers: list[int] = []
    found: list[str] = []

    def add(word: np.ndarray, at: np.ndarray, tail: int, letter: np.ndarray | None) -> None:
        for k in range(len(word)):
            w, i = words[word[k]], int(at[k])
            numbers.append(int(word[k]))
            found.append(w[:i] + ("" if letter is None else letters[letter[k]]) + w[i + tail :])

    for own, points in _by_length(words):
        m, n = points.shape
        power = _powers(n)
        each = _codes(points) * power[:-1]
        before = np.zeros((m, n + 1), np.uint64)
        np.cumsum(each, axis=1, out=before[:, 1:], dtype=np.uint64)
        after = before[:, -1:] - before  # of the letters from a place on
        last = np.ones((m, n), bool)
        last[:, :-1] = points[:, 1:] != points[:, :-1]
        row, at = np.nonzero(last & keep(before[:, :-1] + after[:, 1:] * np.uint64(INVERSE)))
        add(own[row], at, 1, None)
        step = max(1, AT_ONCE // (m * len(letters) or 1))
        for a in range(0, n + 1, step):
            b = min(a + step, n + 1)
            put = (before[:, a:b] + after[:, a:b] * np.uint64(BASE))[:, :, None] + (codes * power[a:b, None])[None]
            other = np.ones(put.shape, bool)
            other[:, : min(b, n) - a] = points[:, a:b, None] != own_letters
            row, at, letter = np.nonzero(other & keep(put))
            add(own[row], at + a, 0, letter)
            b = min(b, n)
            if a < b:
                put = (before[:, a:b] + after[:, a + 1 : b + 1])[:, :, None] + (codes * power[a:b, None])[None]
                row, at, letter = np.nonzero(other[:, : b - a] & keep(put))
                add(own[row], at + a, 1, letter)
    return np.array(numbers, np.int64), found


def _filter(words: DataFrame, n: int) -> np.ndarray:
    """The Bloom filter of n words, as bytes; it has BITS bits for each, up to MOST_BITS in all, and so a proven size."""
    bits = min(MOST_BITS, 1 << max(16, int(n * BITS).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _mixed(hashes(batch.column("word").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_probe(h, i, bits) for i in range(PROBES)]))], ["place"])

    at = words.select("word").mapInArrow(lean(places), "place long").select((F.col("place") + 1).alias("p"))
    parts = at.groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in parts:
        one = np.frombuffer(r.bits, np.uint8)
        start = (r.part - 1) * len(one)
        out[start : start + len(one)] = one[: len(out) - start]
    return out


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every two of words(word, n; durable, distinct words) that one edit makes equal, both ways."""
    spark = words.sparkSession
    letters, n = alphabet(words), words.count()
    if not letters:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    shared = spark.sparkContext.broadcast(_filter(words, n))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        bits = len(filled) * 8

        def keep(h: np.ndarray) -> np.ndarray:
            flat = _mixed(h.ravel())
            alive = None
            for i in range(PROBES):
                place = _probe(flat if alive is None else flat[alive], i, bits)
                hit = (filled[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                alive = np.flatnonzero(hit) if alive is None else alive[hit]
            out = np.zeros(len(flat), bool)
            out[alive] = True
            return out.reshape(h.shape)

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                number, near = neighbourhoods(part.column("word").to_pylist(), letters, keep)
                taken = part.take(pa.array(number))
                yield pa.RecordBatch.from_arrays([taken.column("word"), taken.column("n"), pa.array(near, pa.string())], ["word", "n", "near"])

    dealt = words.select("word", "n").repartition(parallelism(spark), "word")
    made = dealt.mapInArrow(lean(of), "word string, n long, near string")
    return made.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for forms(word, form; durable): from each word, follow forms to the last; the word itself if there is none.

    Pointers double each round, so a chain of k forms takes about log2(k) joins; forms must not go in circles.
    """
    now = durable(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        new = durable(now.join(up, "root").select("word", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root for each of words(word, n), distinct.

    form: the near word of largest n (ties: the first in code-point order) if that is at least `times` n, so n grows from
    word to form and no chain goes in a circle. Null texts have no words, empty tables give an empty result, repeated
    rows of documents count again, words of any length are taken whole; further columns of documents are not read.
    """
    words = durable(words.select("word", "n"))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    own = words.join(best, "word", "left")
    fits = -F.col("best.minus") >= F.lit(times) * F.col("n")
    own = durable(own.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n")))
    return own.join(roots(own.select("word", "form")), "word").select("word", "n", "n_near", "form", "form_n", "root")


def query(spark, documents: DataFrame) -> DataFrame:
    return variants(vocabulary(documents.select("doc_id", "text"))).select("word", "form", "root", "n", "n_near", "form_n")
