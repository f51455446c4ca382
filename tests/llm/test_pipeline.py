import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_take_effect(spark, sample, tmp_path):
    rng = random.Random(1)
    clean = sample.where("length(text) > 800").limit(30).collect()
    passage = " ".join(f"word{rng.randrange(1000)}" for _ in range(60))
    planted = [(50_000, "12345 !!!", None, "src0", 9)]
    planted += [(50_001 + i, r.text, r.lang, r.source, r.n_chars) for i, r in enumerate(clean[:5])]  # exact copies
    planted += [(50_100 + i, r.text[:400] + " " + passage + " " + r.text[400:], r.lang, "src1", 0) for i, r in enumerate(clean[10:13])]
    docs = sample.unionByName(spark.createDataFrame(planted, sample.schema)).withColumn("lang_pred", F.lit("extra")).withColumn("n_removed", F.lit(7))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "source_mix", "bpe"]
    seen = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert docs.columns == seen["input"].columns
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items()}
    assert 50_000 not in ids["language_id"] and len(ids["language_id"]) >= len(ids["input"]) - 2
    assert not ids["near_dedup"] & set(range(50_001, 50_006)) and {r.doc_id for r in clean[:5]} & ids["near_dedup"]
    assert seen["near_dedup"].count() == len(ids["near_dedup"])
    texts = [r.text for r in seen["suffix_dedup"].collect()]
    assert sum(passage in t for t in texts) == 1
    assert seen["suffix_dedup"].where("n_chars <> length(text)").count() == 0
    copies = {r.doc_id: r["count"] for r in seen["source_mix"].groupBy("doc_id").count().collect()}
    assert max(copies.values()) == 2 and set(copies) < ids["suffix_dedup"]
    assert seen["bpe"].count() == sum(copies.values()) and seen["bpe"].where("n_tokens <> size(ids)").count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_stand_odd_and_empty_tables(spark, odd, none, name, stage):
    assert stage(spark, none, "").count() == 0
    docs = odd.withColumn("size", F.lit("s")).withColumn("hash_", F.lit(1)).withColumn("score", F.lit(2)) if name != "bpe" else odd
    got = stage(spark, docs, "")
    assert got.count() <= 2 * docs.count()
    if name != "bpe":
        assert got.columns == docs.columns


def test_without_the_subpackage(tmp_path):
    """The entry imports and has its other queries when the folders are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(os.path.join(root, "voltaic"), tmp_path / "voltaic", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 20 and 'pipeline' not in q and not any(k.startswith('op') for k in q); print(len(e.oracle_sql()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""}).stdout.split()[-1]) > 20
