"""Rows that the near-duplicate stage must not lose or leave: unnamed copies, and texts that share a doc_id."""

from __future__ import annotations

from bytestrata.llm import ngram_join
from tests.llm.conftest import COLUMNS


def near(k: int, changed: int | None = None) -> str:
    words = [f"w{k}x{i}" for i in range(100)]
    if changed is not None:
        words[changed] = "other"
    return " ".join(words)


def test_one_of_each_counts_rows(spark):
    texts = [
        (None, near(1)), (None, near(1, 50)), (None, near(1, 70)),  # unnamed near copies: one stays
        (4, near(2)), (5, near(2, 40)), (None, near(2, 40)), (None, near(2, 60)),  # 4 stays; what equals the removed 5 goes
        (5, near(3)),  # the same doc_id, another text
        (7, near(4)), (7, near(5)), (8, near(5, 30)),  # both texts of 7 stay
        (9, near(6)), (9, near(6, 20)), (9, near(6)),  # one of a doc_id's near copies
        (None, None), (None, None), (None, " "), (10, ""), (10, ""),  # without words: linked with nothing
    ]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], COLUMNS).repartition(5)
    got = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each(df).collect()]
    groups = sorted((str(i), (t or "").split("x")[0]) for i, t in got)
    assert groups == sorted([("None", "w1"), ("4", "w2"), ("5", "w3"), ("7", "w4"), ("7", "w5"), ("9", "w6"), ("None", ""), ("None", ""), ("None", " "), ("10", ""), ("10", "")])
    assert (4, near(2)) in got and (7, near(5)) in got
