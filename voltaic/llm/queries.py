"""The registered queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .common import benchmark, documents, pages

_QUERIES = {
    "op1_spotsigs": ("spotsigs", documents),
    "op2_wrapper_extraction": ("wrapper_extraction", pages),
    "op3_suffix_dedup": ("suffix_dedup", documents),
    "op4_language_id": ("language_id", documents),
    "op5_cube_mixing": ("cube_mixing", documents),
    "op6_bpe_replay": ("bpe", documents),
    "op7_warc_fixity": ("warc_fixity", pages),
    "op8_histogram_sort": ("histogram_sort", documents),
    "op9_simhash_anchors": ("simhash", documents),
    "op10_mpeg_audio": ("mpeg_audio", documents),
    "op11_spelling_variants": ("spelling", documents),
    "op12_importance_resampling": ("importance_resampling", documents, benchmark),
    "op13_token_groups": ("token_groups", documents),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(module: str, *tables: Callable) -> Callable[[SparkSession, str], DataFrame]:
        run = import_module(f".{module}", __package__).query
        return lambda spark, sf_dir: run(spark, *(table(spark, sf_dir) for table in tables))

    return {name: of(*x) for name, x in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express on whole tables; the others are tested against brute force in tests/llm."""
    return {"op7_warc_fixity": import_module(".warc_fixity", __package__).ORACLE}
