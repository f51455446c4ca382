import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaic.llm import near_copies


def text_of(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"x{rng.randrange(10**9)}"
    return words


def kept(texts):
    """Brute force: the smallest number of each group, and the likeness of each two that have some."""
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    label = list(range(len(texts)))
    like = {}
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both:
                like[j, i] = both / (len(sets[i]) + len(sets[j]) - both)
                if like[j, i] >= 0.8:
                    a, b = sorted((label[i], label[j]))
                    label = [a if x == b else x for x in label]
    return set(label), like


def found(spark, texts):
    return {r.doc_id for r in near_copies.survivors(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)).collect()}


@pytest.mark.parametrize("direct", [16, 1])
def test_links_between_groups_are_kept(spark, monkeypatch, direct):
    """Families of many members of which some hang on others by a chain, none by the most central one."""
    rng = random.Random(5)
    texts = []
    for _ in range(3):
        hub = text_of(rng, 400)
        texts += [changed(rng, hub, rng.randrange(4, 9)) for _ in range(60)]
        for _ in range(6):
            chain = hub
            for _ in range(4):
                chain = changed(rng, chain, 5)
                texts.append(chain)
    rng.shuffle(texts)
    monkeypatch.setattr(near_copies, "DIRECT", direct)
    monkeypatch.setattr(near_copies, "SHARE", 4, raising=False)
    assert found(spark, texts) == kept(texts)[0]


def test_long_texts_are_judged_by_all_shingles(spark):
    """Pairs of 900 words a little over and under the bound."""
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        a = text_of(rng, 900)
        texts += [a, changed(rng, a, rng.randrange(17, 26))]
    want, like = kept(texts)
    assert sum(0.8 <= v < 0.83 for v in like.values()) > 5 and sum(0.77 < v < 0.8 for v in like.values()) > 5
    assert found(spark, texts) == want


def test_texts_of_a_common_core_are_not_judged_two_by_two(spark, monkeypatch):
    """Each text has some words of a core changed, so that they meet at its shingles, but few are near copies: judged pairs grow as the texts, not as their square."""
    monkeypatch.setattr(near_copies, "DIRECT", 2)
    monkeypatch.setattr(near_copies, "SHARE", 4)
    plain, judged = near_copies._links, []
    monkeypatch.setattr(near_copies, "_links", lambda own, pairs: judged.append(pairs.count()) or plain(own, pairs))
    rng = random.Random(10)
    core = text_of(rng, 150)
    texts = [changed(rng, core, rng.randrange(3, 6)) for _ in range(560)]
    texts += [changed(rng, t, 2) for t in texts[:40]]
    want, like = kept(texts)
    assert len(like) > 170_000 and 40 <= sum(v >= 0.8 for v in like.values()) < 200
    assert found(spark, texts) == want
    assert sum(judged) < 4 * len(texts)


@pytest.mark.parametrize("wide", [8192, 256])
def test_sketches_leave_out_no_pair_over_the_bound(monkeypatch, wide):
    """Sets of all sizes that overlap by the bound or a little more or less, also those of unequal and of the greatest width."""
    monkeypatch.setattr(near_copies, "WIDE", wide)
    rng = np.random.default_rng(11)
    left_out = 0
    for n in (1, 2, 5, 16, 17, 31, 32, 33, 60, 64, 70, 128, 150, 500, 1024, 1100, 5000):
        for other in {n, max(1, int(n * 0.82)), max(1, int(n * 0.9))}:
            sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64))]
            # From the fewest that may be shared at the bound, and as many as that less a fifth.
            least = min(other, int(np.ceil(0.8 / 1.8 * (n + other) - 1e-6)))
            for shared in (other, least, int(least * 0.6)):
                sets.append(np.unique(np.concatenate((sets[0][:shared], rng.integers(2**63, 2**64 - 1, other - shared, dtype=np.uint64)))))
            m = len(sets)
            size, ids = np.array([len(x) for x in sets], np.int32), np.arange(m)
            sketches = np.empty(m, object)
            sketches[:] = [near_copies.sketch(x) for x in sets]
            width, tables = near_copies._by_width(sketches)
            a, b = np.zeros(m - 1, np.int64), np.arange(1, m)
            apart = near_copies._least_apart(a, b, width, tables)
            assert all(apart[i - 1] <= len(np.setxor1d(sets[0], sets[i])) for i in range(1, m))
            pairs, _ = near_copies._meet(np.zeros(m, np.int64), ids, size, np.zeros(m, np.int32), np.zeros(m, bool), ids, 10**6, sketches)
            got = {tuple(x) for x in pairs.T}
            assert {(i, j) for i in range(m) for j in range(i + 1, m) if near_copies.overlap(sets[i].tobytes(), sets[j].tobytes()) >= 0.8} <= got
            left_out += (0, 3) not in got
    assert left_out > 10


def test_overlap_counts_all():
    a = np.arange(1000, dtype=np.uint64)
    assert near_copies.overlap(a.tobytes(), a[:790].tobytes()) == 0.79 and near_copies.overlap(a[200:].tobytes(), a.tobytes()) == 0.8


def test_no_pair_over_the_bound_is_missed(spark):
    """Short and long texts, texts that share much with many others, parts of others, repeated lines."""
    rng = random.Random(7)
    common = text_of(rng, 40)
    texts = [[], ["one"], ["one", "two"], ["one", "two", "three"]]
    for _ in range(60):
        n = rng.choice((20, 60, 120, 300))
        a = text_of(rng, n)
        a[5:5] = common * rng.randrange(3)
        texts += [a, changed(rng, a, max(1, n // rng.choice((40, 45, 50)))), a[: int(len(a) * rng.uniform(0.75, 0.9))], a + common * 3]
    want, like = kept(texts)
    assert sum(0.8 <= v < 0.85 for v in like.values()) > 20
    assert found(spark, texts) == want


def test_unlike_texts_of_one_hash_stay(spark, monkeypatch):
    """A hash that two unlike texts share; copies of each still go."""
    plain = near_copies.text_hash
    monkeypatch.setattr(near_copies, "text_hash", lambda: F.when(F.startswith("text", F.lit("same")), F.lit(7).cast("long")).otherwise(plain()))
    rows = [(1, "same one two three four five six"), (2, "same red blue green pink grey"), (3, "same one two three four five six"), (4, "other words that stand alone here"), (5, "other words that stand alone here"), (None, "same red blue green pink grey")]
    got = near_copies.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 4]


def test_few_links_are_few_files(spark):
    """Of steps with few rows no file is kept for each of many tasks; on local disks Hadoop starts a process for each file."""
    rng = random.Random(9)
    base = text_of(rng, 200)
    texts = [text_of(rng, 60) for _ in range(20)] + [changed(rng, base, 2) for _ in range(6)]
    own = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        pairs = spark.createDataFrame([(i, i + 1) for i in range(25)], "a long, b long")
        links = near_copies._links(own, near_copies.durable(pairs))
        assert {frozenset((r.a, r.b)) for r in links.collect()} == {frozenset((i, i + 1)) for i in range(20, 25)}
        assert links.rdd.getNumPartitions() <= 8
        members = near_copies.fronts(own, np.zeros(near_copies.CELLS, np.uint32)).selectExpr("shingle", "id", "size", "place", "false as asked", "id as root")
        found = near_copies.durable(near_copies._candidates(members, 16))
        assert found.rdd.getNumPartitions() <= 8 and found.where("b is not null").count() > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
