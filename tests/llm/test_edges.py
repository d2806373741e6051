"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bytestrata.llm import bpe, cover_tree, fingerprints, licenses, mixing, ngram_join, quality, secrets, suffix_dedup, toxicity

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
OPERATORS = {
    "mixing": (lambda d, l: mixing.mixture(d), 15),
    "fingerprints": (lambda d, l: fingerprints.compared(d), 15),
    "suffixes": (lambda d, l: suffix_dedup.repeats(d), 5),
    "secrets": (lambda d, l: secrets.scan(d), 15),
    "quality": (lambda d, l: quality.classified(d, l), 15),
    "bpe": (lambda d, l: bpe.digests(d, PATH, PATTERN), 15),
    "licenses": (lambda d, l: licenses.scan(licenses.document_files(d)), 15),
    "ngrams": (lambda d, l: ngram_join.joined(d), 15),
    "toxicity": (lambda d, l: toxicity.classified(d, l), 15),
}


def rows(df) -> list[str]:
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(odd, clashing, none, labels, name):
    run, n = OPERATORS[name]
    got = rows(run(odd, labels))
    assert len(got) == n
    assert rows(run(clashing, labels)) == got
    assert rows(run(none, labels)) == []


def by_id(df) -> dict:
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r.asDict())
    return out


def test_mixing_values(odd):
    got = by_id(mixing.mixture(odd))
    assert got[6][0]["size"] == 0 and got[6][0]["taken"] == 0 and got[6][0]["position"] is None and got[11][0]["size"] == 0
    assert got[9][0]["size"] == got[10][0]["size"] == 2 and got[8][0]["size"] == 60_000
    taken: dict = {}
    for own in mixing.mix(odd).select("source", "target", "size", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["taken"]).alias("t")).collect():
        taken.setdefault(own["source"], [own["target"], 0])[1] += own["t"]
        assert own["t"] <= 2 * own["size"]
    assert all(abs(t - n) <= 1 for t, n in taken.values())


def test_fingerprint_values(odd):
    got = by_id(fingerprints.compared(odd))
    empty = hashlib.sha256(b"").hexdigest()
    assert got[11][0]["n_chars"] == 0 and got[11][0]["fingerprint"] == "" and got[11][0]["edited_sha256"] == empty and got[11][0]["near_edited"] == 1.0
    assert got[1][0]["fingerprint"] == got[2][0]["fingerprint"] and got[1][0]["near_next"] == 1.0 and len(got[8][0]["fingerprint"]) == 16 * fingerprints.K


def test_copies_link(odd):
    got = by_id(ngram_join.joined(odd))
    assert {r["component_id"] for i in (1, 2, 3) for r in got[i]} == {1} and len(got[3]) == 2
    assert sorted(str(r["component_id"]) for r in got[None]) == ["1", "None"]
    assert got[6][0] == {"doc_id": 6, "n_shingles": 0, "component_id": 6} and got[7][0]["component_id"] == 7
    assert got[9][0]["n_shingles"] == 1 and got[10][0]["component_id"] == 9


def test_one_of_each(odd, clashing):
    for docs in (odd, clashing):
        left = ngram_join.one_of_each(docs)
        assert left.columns == docs.columns
        ids = [r[0] for r in left.collect()]
        assert sorted(str(i) for i in ids) == sorted(["1", "None", "6", "7", "8", "9", "11", "12", "13", "14"])


def test_suffixes_of_copies(odd):
    got = by_id(suffix_dedup.repeats(odd))
    assert got[1][0]["spans"] == "0:120" and got[2][0]["n_repeated"] == 120 and len(got[3]) == 2 and 8 not in got


def test_tokens_round_trip(odd, none):
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"] is not None}
    back = bpe.decode(bpe.encode(odd, PATH, PATTERN), PATH, PATTERN)
    assert all(bytes(r["bytes"]).decode() == texts[r["doc_id"]] for r in back.collect() if r["doc_id"] is not None)
    assert bpe.encode(none, PATH, PATTERN).count() == 0


def test_scores(odd, labels, none):
    nolabels = labels.limit(0)
    for operator in (quality, toxicity):
        got = by_id(operator.classified(odd, nolabels))
        assert all(r["score"] == 0.5 for own in got.values() for r in own) and got[None][0]["held_out"]
        again = by_id(operator.classified(odd, labels))
        assert again[1][0]["score"] == again[2][0]["score"] and 0 <= again[6][0]["score"] <= 1


def test_clean_carries_columns(clashing, labels):
    out = toxicity.clean(clashing, labels, threshold=2.0)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    blotted = secrets.redact(clashing)
    assert blotted.columns == clashing.columns and blotted.count() == clashing.count()
    order = mixing.training_order(clashing)
    assert order.columns == clashing.columns and order.count() > 0


VECTORS = "vec_id long, embedding array<float>, label int"


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows_ = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.05], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [], 1), (14, [-1.0, -0.0], 1), (15, [3e38, 0.0], 1), (16, [1e-40, 0.0], 1)]
    got = [r.asDict() for r in cover_tree.linked(spark.createDataFrame(rows_, VECTORS)).collect()]
    assert len(got) == len(rows_)
    for r in got:
        if r["vec_id"] in (5, 6, 7, 8, 9, 10, 13, 12, 14, 4):
            assert r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"]
        else:
            assert r["n_links"] == 6 and r["component_id"] == 1 and r["kept"] is (r["vec_id"] == 1)
    assert cover_tree.linked(spark.createDataFrame([], VECTORS)).count() == 0
    more = spark.createDataFrame([(*r, 1, "x") for r in rows_], VECTORS + ", unit int, Label string")
    assert sorted(map(str, cover_tree.linked(more).collect())) == sorted(map(str, cover_tree.linked(spark.createDataFrame(rows_, VECTORS)).collect()))
