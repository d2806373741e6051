from __future__ import annotations

import random

import pytest
from pyspark.sql import Row

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def text(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = text(rng, 60_000)
    base = text(rng, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base, "en", "a", len(base)), (2, base, "en", "a", len(base)), (3, near, None, "b", None), (3, near, None, "b", None), (None, base, "en", None, 3), (None, None, None, None, None),
        (6, "", "en", "c", 0), (7, " \n\t ", "en", "c", 4), (8, long, "en", "a", len(long)), (9, "one two", "de", "d", 7), (10, "One\x0btwo", "de", "d", 7), (11, None, "fr", "e", None),
        (12, "émile \U0001f600 日本語 " * 30, "fr", "e", 10), (13, text(rng, 200), "en", "a", 1), (14, text(rng, 80) + "\n" + text(rng, 90), "en", "b", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """The same with columns whose names clash with others by letter case, and with names that operators use."""
    rows = [Row(*r, "x", 1.5, "y", 7) for r in odd_rows()]
    return spark.createDataFrame(rows, COLUMNS + ", TEXT string, score double, Source string, size int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 15)] + [(1, 1, None), (None, 1, 1), (13, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def tables():
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    return folder
