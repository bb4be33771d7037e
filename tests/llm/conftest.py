from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, block int, words string"


def passage(n: int, start: int = 0) -> str:
    return " ".join(f"word{start + i}" for i in range(n))


def odd_rows() -> list[tuple]:
    """Null and empty values, repeated rows, ties, a very long text, and columns named like internal ones."""
    return [
        (1, passage(60), "en", 0, None),
        (2, "Intro " + passage(60) + " outro", "en", None, "x"),
        (3, None, "en", 1, None),
        (4, "", None, 1, ""),
        (5, " \t\n ", "de", 1, "y"),
        (6, "one two", "en", 1, None),
        (7, "One  TWO", "en", 1, None),
        (8, passage(60), "en", 1, None),
        (8, passage(60), "en", 1, None),
        (9, passage(30000, 500), "en", 2, None),
        (10, "été naïve 世界 🙂 " + passage(20, 10), "fr", 2, None),
        (None, passage(60), None, None, None),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def some_docs(spark):
    """Real texts: all of the smallest table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("bucket", F.lit("b"))
