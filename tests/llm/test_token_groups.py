import random
import re

import numpy as np
import pytest

from voltaic.llm import token_groups


def brute(rows, words=4, percent=85):
    """doc_id to (set size, component), by comparing all pairs of texts."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(low)) if x]
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def families(seed, n=40):
    """Texts of few words in families: chains of edits, shared passages, copies, short texts."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = r.choices(vocab, k=40)
    out = []
    for _ in range(n):
        base = r.choices(vocab, k=r.choice([3, 5, 20, 60, 120]))
        if r.random() < 0.4:
            base[:0] = passage
        for _ in range(r.choice([1, 1, 2, 6, 20])):
            out.append(" ".join(base).upper() if r.random() < 0.1 else " ".join(base))
            base = list(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                base[r.randrange(len(base))] = r.choice(vocab)
    r.shuffle(out)
    return list(enumerate(out)) + [(10_000, ""), (10_001, None), (10_002, " \n\t"), (10_003, "")]


def got(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in token_groups.components(df).collect()}


def test_components_match_brute_force(spark):
    rows = families(1)
    assert got(spark, rows) == brute(rows)


def test_hot_tokens_and_many_rounds_match_brute_force(spark, monkeypatch):
    """Blocks and size classes of hot tokens, groups of few members, few asked a round."""
    for name, value in {"HOT": 3, "DEALT": 2, "DIRECT": 1, "GROWTH": 2, "SHARE": 2, "MEMBERS": 3, "PER_HUB": 2, "POSTINGS": 50, "ROWS": 7}.items():
        monkeypatch.setattr(token_groups, name, value)
    rows = families(2, 25)
    assert got(spark, rows) == brute(rows)


def test_the_threshold_is_met_exactly(spark):
    """17 of 20 shared tokens link, 16 of 19 do not."""
    word = [f"v{i}" for i in range(40)]
    a, b = " ".join(word[:20]), " ".join(word[:20] + word[20:23])  # 17 of 20 shingles
    c, d = " ".join(word[20:39]), " ".join([*word[20:39], "x", "y", "z"])  # 16 of 19
    assert got(spark, [(1, a), (2, b), (3, c), (4, d)]) == {1: (17, 1), 2: (20, 1), 3: (16, 3), 4: (19, 4)}


def test_nulls_ties_and_empty_tables(spark, odd, none):
    assert token_groups.components(none).count() == 0
    out = token_groups.components(odd).collect()
    assert len(out) == odd.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by[1] == [(11, 1), (11, 1)] and by[2] == [(11, 1)]
    assert by[3] == [(0, 3)] and by[4] == [(0, 4)] and by[5] == [(0, 5)] and by[9] == [(1, 9)]
    assert by[None] == [(9, None)]


@pytest.mark.parametrize("seed", range(20))
def test_a_group_counts_what_two_sets_share(seed):
    """Groups of several members link as sets do."""
    r = np.random.default_rng(seed)
    base = r.choice(400, 100, replace=False)
    sets = []
    for _ in range(12):
        own = base.copy()
        own[r.choice(100, r.integers(0, 14), replace=False)] = r.integers(400, 5000, 1)
        sets.append(np.unique(own).astype(np.uint64) << np.uint64(9))
    a, b = token_groups.Group.of(1, sets[:7], 85), token_groups.Group.of(2, sets[7:], 85)
    a = token_groups.Group.stored(1, *a.columns())
    want = {(1 << 6 | int(a.local[i]), 2 << 6 | int(b.local[j])) for i in range(7) for j in range(5) if 100 * len(np.intersect1d(sets[i], sets[7 + j])) >= 85 * len(np.union1d(sets[i], sets[7 + j]))}
    assert set(a.links(b, 85)) == want
