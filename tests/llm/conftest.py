import tempfile

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="evigraph-tests-"))


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


ODD_SCHEMA = "doc_id long, text string, lang string, source string, row int, n int, shard int, _row int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(20_000))
    rows = [
        (1, "The quick brown fox. " * 20, "en", "a", 1, 1, 1, 1),
        (1, "The quick brown fox. " * 20, "en", "a", 1, 1, 1, 1),
        (1, "Another text of the same id", "en", "a", 1, 1, 1, 1),
        (2, None, "en", None, None, None, None, None),
        (3, "", None, "a", 2, 2, 2, 2),
        (4, " \t\n\n ", "fr", "b", 2, 2, 2, 2),
        (5, long, "en", "b", 2, 2, 2, 2),
        (6, long + " end", "en", "b", 2, 2, 2, 2),
        (None, "No id here, none at all", "en", "a", 3, 3, 3, 3),
        (None, None, None, None, None, None, None, None),
        (7, "¡Ñandú! 12345 \x00 ² 🎉", "es", "c", 3, 3, 3, 3),
    ]
    return spark.createDataFrame(rows, ODD_SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
