import numpy as np
from pyspark.sql import functions as F

from voltaic.llm import language_id as l


def brute(score, many, penalty):
    out, at = [], 0
    for n in many:
        v, back = None, []
        for t in range(n):
            s = score[at + t].astype(np.float32)
            if v is None:
                v, b = s.copy(), list(range(len(s)))
            else:
                best = int(v.argmax())
                top = np.float32(v[best] - np.float32(penalty))
                b = [k if v[k] >= top else best for k in range(len(s))]
                v = np.maximum(v, top) + s
            back.append(b)
        state, own = (int(v.argmax()) if n else 0), []
        for b in reversed(back):
            own.append(state)
            state = b[state]
        out += own[::-1]
        at += n
    return out


def test_viterbi_matches_brute_force():
    rng = np.random.default_rng(3)
    many = np.array([0, 5, 1, 30, 0, 7, 30])
    score = rng.normal(size=(many.sum(), 4)).astype(np.float32) * 3
    assert l.viterbi(score, many, 2.0).tolist() == brute(score, many, 2.0)
    assert l.viterbi(score[:0], np.array([0, 0]), 2.0).tolist() == []


def test_held_out_accuracy(spark, sample):
    got = l.query(spark, sample).join(sample.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() >= 0.95
    assert got.score.between(0, 1).all() and got.doc_id.is_unique


def test_spans_of_mixed_text(spark, sample):
    model = l.train(sample)
    parts = {r.lang: r.text for r in sample.where("length(text) between 300 and 900").dropDuplicates(["lang"]).collect()}
    a, b = sorted(parts)[:2]
    langs, shares, spans = l.identify([parts[a] + " " + parts[b]], model)
    assert {x[0] for x in spans[0]} >= {a, b} and 0.2 < shares[0] < 0.9
    assert sum(n for _, n in spans[0]) == len(l.Words([parts[a] + " " + parts[b]]).length)


def test_scripts_narrow_candidates(spark):
    docs = spark.createDataFrame([("привет мир как дела сегодня", "ru"), ("hello world how are you today", "en")], "text string, lang string")
    model = l.train(docs)
    langs, shares, spans = l.identify(["зxщ qqq", "жжж", "日本", "", "123", "xyz"], model)
    assert langs[1] == "ru" and langs[5] == "en" and langs[3:5] == ["und", "und"] and langs[2] in ("en", "ru")


def test_text_only_decides(spark, odd, none):
    model = l.train(odd)
    a = l.detect(odd.withColumn("spans", F.lit(1)).withColumn("SCORE", F.lit("x")), model)
    b = l.detect(odd.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.lit(0).cast("long")), model)
    pick = lambda df: sorted(map(str, df.select("text", "lang_pred", "score").collect()))
    assert pick(a) == pick(b) and a.count() == odd.count()
    und = {r.doc_id for r in a.where("lang_pred = 'und'").collect()}
    assert und == {3, 4, 5, 8}
    assert l.detect(none, model).count() == 0
    nothing = l.train(none)
    assert {r.lang_pred for r in l.detect(odd, nothing).collect()} == {"und"}


def test_training_rows(spark, sample):
    import zlib

    got = {r.doc_id for r in sample.where(l.training()).collect()}
    assert got == {r.doc_id for r in sample.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}


def test_pieces_do_not_matter(spark, sample, monkeypatch):
    model = l.train(sample)
    items = [r.text for r in sample.limit(40).collect()]
    whole = l.identify(items, model)
    monkeypatch.setattr(l, "PIECE", 500)
    assert l.identify(items, model) == whole


def test_more_labels_than_a_byte_holds():
    rng = np.random.default_rng(4)
    many = np.array([40, 3, 0, 25])
    for k in (128, 129, 400):
        score = rng.normal(size=(many.sum(), k)).astype(np.float32) * 3
        got = l.viterbi(score, many, 2.0)
        assert got.tolist() == brute(score, many, 2.0) and got.max() > 120
