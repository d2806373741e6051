"""The pipeline's stages on the smallest tables, each against plain Python on its own input."""

from __future__ import annotations

import public_tokenizers
import tiktoken

import corpus_pipeline
from bytestrata.llm import bpe, mixing, toxicity
from tests.llm.test_brute import base, shingles


def test_stages(spark, tables):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "tokens"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, tables))
        kept[name] = (docs, out)
        if name != "tokens":
            assert out.columns == docs.columns
        docs = out

    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.classified(before, labels).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, s in scores.items() if s < toxicity.THRESHOLD)

    before, after = kept["near_duplicates"]
    rows = {r["doc_id"]: shingles(r["text"], 5, True) for r in before.collect()}
    top = {i: i for i in rows}
    for a in rows:
        for b in rows:
            if a < b and rows[a] and 100 * len(rows[a] & rows[b]) >= 80 * len(rows[a] | rows[b]):
                x, y = top[a], top[b]
                top = {i: min(x, y) if t in (x, y) else t for i, t in top.items()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({t for t in top.values()})

    before, after = kept["secrets"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    blotted = {r["doc_id"]: r["text"] for r in after.collect()}
    assert texts.keys() == blotted.keys()
    for i, t in texts.items():
        assert not base(blotted[i]) and (base(t) or "[SECRET]" in blotted[i] or blotted[i] == t)

    before, after = kept["mixing"]
    taken = {r["doc_id"]: sum(2 * c["taken"] >= r["size"] for c in r["copies"]) for r in mixing.mix(before).collect()}
    got: dict = {}
    for r in after.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {i: n for i, n in taken.items() if n}

    before, after = kept["tokens"]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(r["ids"] == plain.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in after.collect())

    assert corpus_pipeline.run(spark, tables).count() == after.count()
