import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaic.llm import spotsigs


def brute(text):
    """Spots one word at a time: anchor and the next content words, repeats numbered."""
    import re

    anchors = set(spotsigs.ANCHORS.split())
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
    spots, seen = set(), {}
    for i, w in enumerate(words):
        if w in anchors:
            chain = [x for x in words[i + 1 :] if x not in anchors][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                key = (w, *chain)
                seen[key] = seen.get(key, 0) + 1
                spots.add((*key, seen[key]))
    if not spots:
        for w in words:
            seen[w] = seen.get(w, 0) + 1
            spots.add((w, seen[w]))
    return spots


def test_signatures_match_brute_force(sample):
    texts = [r[0] for r in sample.select("text").limit(60).collect()] + ["", "the", "a b c d e", "The Fox the fox THE fox", "é 日本", "x " * 5000]
    got, want = spotsigs.signatures(texts), [brute(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for i in range(0, len(texts) - 1):
        a, b = want[i], want[i + 1]
        assert spotsigs.likeness(got[i], got[i + 1]) == pytest.approx(1.0 if not a | b else len(a & b) / len(a | b))


def test_likeness_prunes_by_length():
    a, b = np.arange(10, dtype=np.uint32), np.arange(4, dtype=np.uint32)
    assert spotsigs.likeness(a, b) == 0.4 and spotsigs.likeness(a, b, 0.5) == 0.0
    assert spotsigs.likeness(a[:0], b[:0]) == 1.0 and spotsigs.likeness(a[:0], b) == 0.0
    assert (spotsigs.decoded(spotsigs.encoded(a)) == a).all()


def test_query(spark, sample):
    got = {r.doc_id: r for r in spotsigs.query(spark, sample).collect()}
    texts = {r.doc_id: r.text or "" for r in sample.collect()}
    ids = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    for i, d in enumerate(ids):
        text, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = brute(text), brute(edited), brute(after)
        assert got[d].near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert got[d].near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)


def test_odd_rows(spark, odd, none):
    got = spotsigs.query(spark, odd.withColumn("part", F.lit(1)).withColumn("fingerprint", F.lit("x"))).collect()
    assert len(got) == odd.count()
    same = {r.fingerprint for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1 and {r.n_chars for r in got if r.doc_id in (3, 4)} == {0}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert [r.near_next for r in got if r.doc_id == 4] == [1.0]  # the next one, 3, is null: both are empty
    assert spotsigs.query(spark, none).count() == 0
    alone = spotsigs.query(spark, odd.where("doc_id = 9")).first()
    assert (alone.near_edited, alone.near_next) == (1.0, 1.0)


def test_join_matches_brute_force(spark, sample, odd, none):
    docs = sample.unionByName(odd.where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 100_000))
    got = {(r.doc_id, r.class_id): r for r in spotsigs.near_duplicates(docs, 0.5).collect()}
    prints = {r.doc_id: spotsigs.encoded(spotsigs.signatures([r.text or ""])[0]) for r in docs.collect()}
    first = {}
    for d in sorted(prints):
        first.setdefault(prints[d], d)
    heads = sorted(first.values())
    sets = {d: spotsigs.decoded(prints[d]) for d in heads}
    pairs = [(a, b) for i, a in enumerate(heads) for b in heads[i + 1 :] if len(sets[a]) and len(sets[b]) and spotsigs.likeness(sets[a], sets[b]) >= 0.5]
    links = {d: sum(d in p for p in pairs) for d in heads}
    parent = {d: d for d in heads}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {(d, first[p]): (find(first[p]), links[first[p]]) for d, p in prints.items()}
    assert {k: (r.component_id, r.links) for k, r in got.items()} == want
    assert spotsigs.near_duplicates(none).count() == 0
