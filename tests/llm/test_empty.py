"""The operators that return documents: empty tables, nulls in every column, and ids that are none."""

from __future__ import annotations

import public_tokenizers
import pytest

from bytestrata.llm import bpe, mixing, ngram_join, secrets, suffix_dedup, toxicity
from bytestrata.llm.common import cut, discard, shared_folder

NULLS = (None, None, None, None, None)


@pytest.mark.parametrize("name", ["clean", "redact", "order", "one"])
def test_documents_in_documents_out(spark, none, name):
    labels = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    run = {"clean": lambda d: toxicity.clean(d, labels), "redact": secrets.redact, "order": mixing.training_order, "one": ngram_join.one_of_each}[name]
    assert run(none).columns == none.columns and run(none).count() == 0
    only = spark.createDataFrame([NULLS, NULLS], none.schema)
    if name == "clean":  # of documents with ids and labels the classifier learns that nothing is toxic
        some = only.unionByName(spark.createDataFrame([(i, f"word {i}", None, None, None) for i in range(20)], none.schema))
        assert run(some).count() == 22
        assert toxicity.clean(some, labels.limit(0)).count() == 22  # without labels none is known to be toxic
        return
    kept = run(only).collect()
    assert [tuple(r) for r in kept] == ([] if name == "order" else [NULLS, NULLS])  # a mix takes no words of what has none


def test_decode_nulls(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    by_id = {i: p for p, i in bpe.read_ranks(path).items()}
    rows = [(1, [300, 4000, 7]), (2, []), (3, None), (None, [300]), (4, [None, 300, None])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(df, path, public_tokenizers.PATTERN).collect()}
    assert got == {i: b"".join(by_id[x] for x in ids or [] if x is not None) for i, ids in rows}


def test_tables_are_removed(spark, odd):
    import os

    table = cut(odd)
    at = table._folder.removeprefix("file:")
    assert os.path.isdir(at) and table.count() == odd.count() and shared_folder(spark) in table._folder
    discard(table)
    assert not os.path.exists(at)


def test_repeats_that_neighbours_hide(spark):
    """Of the suffixes inside of what 1 and 3 share, 1's nearest is in 2: it reaches further right and differs on the left, in 45 words."""
    w = [f"w{i}" for i in range(200)]
    a = " ".join(w[:60] + [f"a{i}" for i in range(60)])
    b = " ".join([f"b{i}" for i in range(30)] + w[30:60] + [f"a{i}" for i in range(15)] + [f"c{i}" for i in range(60)])
    c = " ".join(w[:60] + [f"d{i}" for i in range(60)])
    got = {r["doc_id"]: r["spans"] for r in suffix_dedup.repeats(spark.createDataFrame([(1, a), (2, b), (3, c)], "doc_id long, text string")).collect()}
    assert got == {1: "0:60", 3: "0:60"}
