import collections
import random
import re
import zlib

import pytest

from voltaic.llm import spelling


def words_of(rows):
    """Counts of the words of (doc_id, text) rows, as the contract says."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(n):
    """word to (form, root, n, n_near, form_n), comparing every two words."""
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(near[a], key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= 5 * n[a] else None

    def root(a):
        while form[a]:
            a = form[a]
        return a

    return {a: (form[a], root(a), n[a], len(near[a]), n[form[a]] if form[a] else None) for a in n}


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_matches_brute_force(spark):
    r = random.Random(5)
    bases = ["".join(r.choice("aabcé") for _ in range(r.randrange(5, 9))) for _ in range(60)]
    rows = []
    for i in range(300):
        text = []
        for _ in range(40):
            w = bases[min(int(r.expovariate(0.1)), 59)]
            if r.random() < 0.1:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + "bÉ"[r.randrange(2)] + w[k + 1 :], w[:k] + "a" + w[k:]])
            text.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, ", ".join(text)))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = rows_of(spelling.query(spark, df))
    want = brute(words_of(rows))
    assert got == want
    assert any(v[0] for v in want.values()) and max(v[3] for v in want.values()) > 3


def test_forms_are_followed_to_the_last(spark):
    """A chain of four words, each five times as frequent; ties by code point; words without a letter in common."""
    n = {"aaaaaa": 625, "aaaaab": 125, "aaaabb": 25, "aaabbb": 5, "zzzzzz": 5, "yyyyyy": 30, "yyyyyx": 30, "yyyyyw": 6, "yyyyyyy": 30}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = rows_of(spelling.variants(df))
    assert got == brute(n)
    assert got["aaabbb"][:2] == ("aaaabb", "aaaaaa") and got["yyyyyw"][0] == "yyyyyx" and got["zzzzzz"] == (None, "zzzzzz", 5, 0, None)


@pytest.mark.parametrize("word", ["aab", "éé", "b", "abcabc", "aaaa"])
def test_a_neighbourhood_is_whole_and_distinct(word):
    letters = "abcé"
    number, found = spelling.neighbourhoods([word], letters, lambda h: h == h)
    want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    assert sorted(found) == sorted(want - {word}) and set(number) == {0}
    hashes = spelling.hashes(found)
    kept = []
    spelling.neighbourhoods([word], letters, lambda h: kept.extend(h.ravel().tolist()) or h == h)
    assert set(hashes.tolist()) <= set(kept)


def test_the_filter_never_drops_a_word(spark, monkeypatch):
    """Even a filter that is far too small gives the same rows."""
    monkeypatch.setattr(spelling, "MOST_BITS", 1 << 10)
    monkeypatch.setattr(spelling, "AT_ONCE", 500)
    r = random.Random(9)
    n = {"".join(r.choice("ab") for _ in range(r.randrange(6, 10))): r.randrange(5, 200) for _ in range(200)} | {"ab" * 2000: 9, "ab" * 1999 + "b": 5, "ab" * 2000 + "a": 50}
    assert rows_of(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute(n)


def test_nulls_repeats_long_texts_and_empty_tables(spark, odd, none):
    assert spelling.query(spark, none).count() == 0
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(spelling.query(spark, odd)) == brute(words_of(rows))
