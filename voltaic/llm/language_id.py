"""Language identification: scripts narrow the candidates, then Viterbi over per-word scores labels spans of one language.

A word is a run of letters. Its score for a language is the log probability of its character trigrams (hashed, lower
case, with the word's edges) in that language's training texts. Staying in a language is free; a change costs `penalty`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, lean, texts, without

CELLS = 1 << 16
SLICES = 16
PENALTY = 14.0
#: Code points that are worked on at once; a longer text is worked on alone.
PIECE = 1_000_000
#: Least share of a language's training letters in a script for which the language stays a candidate there.
SHARE = 0.001
#: First and last code point of the scripts' blocks.
SCRIPTS = {
    "Latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Armenian": ((0x530, 0x58F),),
    "Hebrew": ((0x590, 0x5FF),),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "Devanagari": ((0x900, 0x97F),),
    "Bengali": ((0x980, 0x9FF),),
    "Tamil": ((0xB80, 0xBFF),),
    "Thai": ((0xE00, 0xE7F),),
    "Georgian": ((0x10A0, 0x10FF),),
    "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "Kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "Han": ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)),
}
MODEL = "lang string, slice int, counts binary"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the first plane: is it a letter; the number of its script."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
    script = np.full(0x10000, len(SCRIPTS), np.int8)
    for k, blocks in enumerate(SCRIPTS.values()):
        for a, b in blocks:
            script[a : b + 1] = k
    return letter, script


class Words:
    """The words of some texts: trigram cells of all letters, each word's first letter, length, text and script."""

    def __init__(self, items: list[str]):
        letter, script = _tables()
        joined = "\n".join(items).lower() + "\n"
        self.cp = cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(cp, 0xFFFF)
        is_letter = letter[low]
        for i in np.flatnonzero(cp > 0xFFFF):
            is_letter[i] = chr(cp[i]).isalpha()
        edge = np.diff(is_letter.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        masked = np.where(is_letter, cp, 0)
        before, after = np.concatenate(([0], masked[:-1])).astype(np.uint32), np.concatenate((masked[1:], [0])).astype(np.uint32)
        h = (before * np.uint32(0x9E3779B1)) ^ ((masked * np.uint32(0x85EBCA6B)) >> np.uint32(3)) ^ (after * np.uint32(0xC2B2AE35))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        at = np.flatnonzero(is_letter)
        self.cell = (h >> np.uint32(16))[at].astype(np.int64)
        self.length = end - start
        self.first = np.cumsum(self.length) - self.length
        self.script = script[low[start]].astype(np.int64)
        if len(items) == 1:
            self.text = np.zeros(len(start), np.int64)
        else:
            # Each text's lower case has its own length, which "\n" within texts hides; so lengths are counted apart.
            ends = np.cumsum(np.fromiter((len(x.lower()) for x in items), np.int64, len(items)) + 1)
            self.text = np.searchsorted(ends, start, "right")


def _pieces(items: list[str]) -> Iterator[tuple[int, int]]:
    """Index ranges of about PIECE code points each."""
    i = size = 0
    for j, x in enumerate(items):
        if size and size + len(x) > PIECE:
            yield i, j
            i, size = j, 0
        size += len(x) + 1
    if i < len(items):
        yield i, len(items)


def training(doc_id: str = "doc_id"):
    """The rows that the query learns from: crc32 of doc_id as text, modulo 4, is not 2; a null doc_id is none of them."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def train(labelled: DataFrame) -> dict:
    """Trigram and script counts per language of labelled(text, lang), all of them; nothing is sampled.

    Each task sends one table of fixed size per language it saw; what the driver gets is one such table per language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, items = np.array(batch.column("lang").to_pylist(), object), texts(batch.column("text"))
            for i, j in _pieces(items):
                words = Words(items[i:j])
                of = langs[i:j][words.text] if len(words.text) else np.empty(0, object)
                for lang in set(of):
                    own = of == lang
                    got = sums.setdefault(lang, np.zeros(CELLS + 64, np.int64))
                    got[:CELLS] += np.bincount(words.cell[np.repeat(own, words.length)], minlength=CELLS)
                    got[CELLS:] += np.bincount(words.script[own], words.length[own], 64).astype(np.int64)
        for lang, got in sums.items():
            parts = np.array_split(got, SLICES)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * SLICES), pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["lang", "slice", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in group["counts"])
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "slice": group["slice"].iloc[:1], "counts": [total.tobytes()]})

    got = labelled.where("lang is not null").select("lang", "text").mapInArrow(lean(count), MODEL).groupBy("lang", "slice").applyInPandas(add, MODEL).toPandas()
    langs = sorted(got["lang"].unique())
    if not langs:
        return {"langs": [], "score": np.zeros((CELLS, 0), np.float32), "may": np.zeros((64, 0), bool)}
    counts = np.stack([np.concatenate([np.frombuffer(x, np.int64) for x in got[got["lang"] == lang].sort_values("slice")["counts"]]) for lang in langs], axis=1)
    cells, scripts = counts[:CELLS].astype(float), counts[CELLS:]
    score = np.log((cells + 0.5) / (cells.sum(axis=0) + 0.5 * CELLS))
    return {"langs": langs, "score": score.astype(np.float32), "may": scripts >= SHARE * np.maximum(scripts.sum(axis=0), 1)}


def viterbi(score: np.ndarray, many: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; many: how many words each text has, texts end to end. Ties stay, then go to the first label."""
    start = np.cumsum(many) - many
    order = np.argsort(-many, kind="stable")
    order = order[many[order] > 0]
    start, many = start[order], many[order]
    kind = np.int8 if score.shape[1] <= 128 else np.int32
    label, back = np.zeros(len(score), kind), np.zeros(score.shape, kind)
    if not len(order):
        return label
    steps = int(many[0])
    live = np.searchsorted(-many, -np.arange(steps), "left")  # texts with more than t words
    own = np.arange(score.shape[1], dtype=kind)
    value = score[start].copy()
    back[start] = own
    for t in range(1, steps):
        k = live[t]
        v, at = value[:k], start[:k] + t
        best = v.argmax(axis=1)
        top = np.take_along_axis(v, best[:, None], 1) - penalty
        stay = v >= top
        back[at] = np.where(stay, own, best[:, None].astype(kind))
        value[:k] = np.where(stay, v, top) + score[at]
    state = value.argmax(axis=1).astype(kind)
    for t in range(steps - 1, -1, -1):
        k = live[t]
        at = start[:k] + t
        label[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return label


def label_words(items: list[str], model: dict, penalty: float = PENALTY) -> tuple[Words, np.ndarray]:
    words = Words(items)
    n = len(words.length)
    score = np.zeros((n, len(model["langs"])), np.float32)
    if n:
        for k in range(score.shape[1]):
            score[:, k] = np.add.reduceat(model["score"][:, k][words.cell], words.first)
        score -= score.max(axis=1, keepdims=True)
        may = model["may"][words.script]
        some = may.any(axis=1, keepdims=True)
        score = np.where(some & ~may, np.float32(-60), np.where(some, score, np.float32(0)))
    return words, viterbi(score, np.bincount(words.text, minlength=len(items)), penalty)


def identify(items: list[str], model: dict, penalty: float = PENALTY) -> tuple[list[str], list[float], list[list[tuple[str, int]]]]:
    """Per text the language with most letters, its share of the letters, and the spans (language, words) in order."""
    langs, shares, spans = [], [], []
    for i, j in _pieces(items):
        part = items[i:j]
        words, label = label_words(part, model, penalty) if model["langs"] else (Words(part), np.empty(0, np.int8))
        if not model["langs"]:
            langs += ["und"] * (j - i)
            shares += [0.0] * (j - i)
            spans += [[] for _ in part]
            continue
        k = len(model["langs"])
        letters = np.bincount(words.text * k + label, words.length, k * (j - i)).reshape(-1, k)
        total = letters.sum(axis=1)
        top = letters.argmax(axis=1)
        langs += ["und" if not t else model["langs"][a] for a, t in zip(top, total)]
        shares += [float(x[a] / t) if t else 0.0 for x, a, t in zip(letters, top, total)]
        new = np.flatnonzero((np.diff(words.text, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
        size = np.diff(new, append=len(label))
        own: list[list[tuple[str, int]]] = [[] for _ in part]
        for text, lab, n in zip(words.text[new].tolist(), label[new].tolist(), size.tolist()):
            own[text].append((model["langs"][lab], n))
        spans += own
    return langs, shares, spans


def detect(docs: DataFrame, model: dict, penalty: float = PENALTY) -> DataFrame:
    """docs with lang_pred, score and spans (array of language and number of words, in the text's order).

    Only the text counts. Null, empty and letterless texts are `und` with score 0 and no spans, and so is everything
    if nothing was learned. Columns of these names are replaced, others pass through; rows are independent of each other.
    """
    docs = without(docs, "lang_pred", "score", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size per language
    schema = extended(docs, "lang_pred string, score double, spans array<struct<lang:string,words:int>>")
    kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, shares, spans = identify(texts(batch.column("text")), shared.value, penalty)
            spans = pa.array([[{"lang": a, "words": n} for a, n in x] for x in spans], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(shares, pa.float64()), spans], [*batch.schema.names, "lang_pred", "score", "spans"])

    return docs.mapInArrow(lean(run), schema)


def query(spark, documents: DataFrame) -> DataFrame:
    model = train(documents.where(training()))
    out = detect(documents.select("doc_id", "text"), model).drop("text")
    return out.select("doc_id", F.coalesce(~training(), F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
