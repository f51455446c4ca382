import os

import pytest

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sample(spark):
    """The driver's smallest table of documents."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows."""
    long = "the quick brown fox and the lazy dog of a house by the river " * 3000
    rows = [
        (1, "the quick brown fox and the lazy dog of a house by the river", "en", "a", 60),
        (1, "the quick brown fox and the lazy dog of a house by the river", "en", "a", 60),
        (2, "the quick brown fox and the lazy dog of a house by the river", "en", "b", 60),
        (3, None, None, None, None),
        (None, "le chat est sur la table avec une souris dans la maison", "fr", "a", 5),
        (4, "", "en", "b", 0),
        (5, " \t\n ", "de", "c", 4),
        (6, long, "en", None, len(long)),
        (7, "日本語のテキスト 😀 é x", None, "c", 3),
        (8, "12345 !!! ???", "es", "a", 13),
        (9, "a", "en", "a", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
