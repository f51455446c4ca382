import base64
import hashlib
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voltaic.llm import bpe, common, suffix_dedup

tokens = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = tokens.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH, tokens.PATTERN)


def ids(encoder, items):
    return [[int(x) for p in parts for x in p[0].split(b",")] for parts in encoder.encode(items)]


def test_texts_match_the_library(sample, encoder, library):
    items = [r.text for r in sample.limit(100).collect()]
    assert ids(encoder, items) == [library.encode_ordinary(t) for t in items]


def test_fuzz_matches_the_library(encoder, library):
    rng = random.Random(5)
    bits = ["a", " ", "  ", "\n", " \n", "\n ", "aaaa", "aaaaaaa", "b", "é", "ß", "日本", "\x1c", "\x85", "　", "\xa0", "'s", "'", "12", "!!!", "ab", "the", " th", "\t", "\r\n", "😀", "ing", "zzzzzz", "<|endoftext|>", "́", "x" * 40]
    items = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert ids(encoder, items) == [library.encode_ordinary(t) for t in items]


def test_merges_match_one_word_at_a_time(encoder):
    def alone(word):
        parts = [bytes([b]) for b in word]
        while True:
            ranked = [(encoder.ranks.ids.get(parts[i] + parts[i + 1], 10**9), i) for i in range(len(parts) - 1)]
            if not ranked or min(ranked)[0] == 10**9:
                return [encoder.ranks.ids[p] for p in parts]
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(9)
    words = [bytes(rng.choice(b"aabcdeingth \xc3\xa9\xe6\x97") for _ in range(rng.randrange(1, 30))) for _ in range(800)]
    ids, many = encoder.ranks._replay(words)
    want = [alone(w) for w in words]
    assert ids.tolist() == [i for x in want for i in x] and many.tolist() == [len(x) for x in want]
    assert [len(x) for x in encoder.ranks._replay([])] == [0, 0] and encoder.ranks.encode_words([]) == ([], [])


def test_memory_of_words_may_be_lost(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "PIECE", 10)
    items = ["one two three four five six", "seven eight one two", "", "nine"] * 3
    own = bpe.Encoder(PATH, tokens.PATTERN)
    assert [[int(x) for p in parts for x in p[0].split(b",")] for parts in own.encode(items)] == [library.encode_ordinary(t) for t in items]


def test_query(spark, odd, none, library):
    docs = odd.withColumn("ids", F.lit("old")).withColumn("N_TOKENS", F.lit(1))
    got = bpe.query(spark, docs).collect()
    want = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        x = library.encode_ordinary(want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(want[r.doc_id].encode()).hexdigest())
    full = {r.doc_id: r["ids"] for r in bpe.encode(docs).collect()}
    assert full[7] == library.encode_ordinary(want[7]) and full[3] == []
    assert bpe.query(spark, none).count() == 0 and bpe.encode(none).count() == 0


@pytest.mark.parametrize("word", ["a" * 1_000_000, "ab" * 150_000, "é" * 100_000, "".join(random.Random(5).choices("aeinrst", k=300_000))])
def test_long_matches_take_no_quadratic_time(encoder, library, word):
    start = time.perf_counter()
    parts = next(encoder.encode([word]))
    assert time.perf_counter() - start < 60
    short = word[: bpe.LONG * 8]
    assert b",".join(x[0] for x in next(encoder.encode([short]))) == ",".join(map(str, library.encode_ordinary(short))).encode()
    assert b"".join(x[2] for x in parts) == word.encode()


def test_long_and_short_words_agree(encoder):
    rng = random.Random(6)
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 4 * bpe.LONG))).encode() for letters in ("ab", "aaab", "etaoin", "ñéa") for _ in range(40)]
    ranks = encoder.ranks
    flat, ends = ranks.encode_words(words)
    got = [flat[i:j] for i, j in zip([0, *ends], ends)]
    ids, many = ranks._replay(words)
    ends = many.cumsum().tolist()
    assert [x if w not in ranks.ids else None for w, x in zip(words, got)] == [ids[i:j].tolist() if w not in ranks.ids else None for w, i, j in zip(words, [0, *ends], ends)]
    assert all(ranks._replay_one(w) == ids[i:j].tolist() for w, i, j in zip(words, [0, *ends], ends))


def _batch(items):
    return pa.RecordBatch.from_arrays([pa.array(range(len(items)), pa.int64()), pa.array(items, pa.string())], ["doc_id", "text"])


def _same(table):
    return table


def test_a_worker_forgets_when_another_step_begins():
    run = lambda step, batch: list(common.lean(step)(iter([batch])))
    run(bpe._encoded(None, None, False), _batch(["a word"]))
    run(bpe._encoded(None, None, False), _batch(["a word"]))
    assert bpe.encoder.cache_info().currsize == 1 and bpe.encoder.cache_info().hits  # its own next task finds it
    assert not list(common.lean(suffix_dedup._samples_sent(1, "doc_id", "text"))(iter([])))
    assert bpe.encoder.cache_info().currsize == 0
    (again,) = run(bpe._encoded(None, None, False), _batch(["a word"]))
    assert again.column("n_tokens").to_pylist() == [2]
    common.lean_group(_same)(pa.table({"x": [1]}))
    assert bpe.encoder.cache_info().currsize == 0


def test_ids_of_a_batch_are_sent_in_pieces(monkeypatch):
    items = [None, "", "one two", "three four five", None, "x" * 50, "", "six", "sept huit é", None]
    whole = list(bpe._encoded(None, None, True)(iter([_batch(items)])))
    monkeypatch.setattr(bpe, "PIECE", 20)
    parts = list(bpe._encoded(None, None, True)(iter([_batch(items), _batch([])])))
    assert len(whole) == 1 and len(parts) > 3
    assert all(sum(len((x or "").encode()) for x in p.column("text").to_pylist()) <= 20 or len([x for x in p.column("text").to_pylist() if x]) == 1 for p in parts)
    assert pa.Table.from_batches(parts).combine_chunks().to_pylist() == whole[0].to_pylist()
