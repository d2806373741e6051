"""Markov spans against plain Python, and texts that are long in one way or another."""

from __future__ import annotations

import random
import re
import time

import pytest

from bytestrata.llm import secrets
from tests.llm.test_brute import CASES, base, documents
from tests.llm.test_secret_pieces import BESIDE


def open_pieces(text: str) -> list[tuple[int, int]]:
    covered = [False] * len(text)
    for a, _, b in base(text):
        covered[a:b] = [True] * (b - a)
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
        a = m.start()
        for i in range(m.start(), m.end() + 1):
            if i == m.end() or covered[i]:
                if i - a >= 20:
                    out.append((a, i))
                a = i + 1
    return out


def markov(text: str, table: list[float]) -> list[tuple[int, int]]:
    out = []
    for a, b in open_pieces(text):
        run = text[a:b]
        steps = [table[(ord(x) - 43) * 80 + ord(y) - 43] for x, y in zip(run, run[1:])]
        if sum(steps) / len(steps) >= secrets.THRESHOLD:
            out.append((a, b))
    return out


def mixed(rng: random.Random) -> str:
    """Base spans that overlap each other and runs, side by side and apart."""
    parts = ["token=", "AKIA", "password: ", " ", "/", "-", ".", "0123456789abcdef01234567", "ABCDEFGHIJKLMNOP", "q7Zp2LxV9sKd4TnB1mYw8RfG", "internationalisation_of_everything", "é", "secret=\"", "\n"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))


def test_markov_spans(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    table = [round(x, 6) for x in secrets.fit(secrets.labelled_samples(docs))]
    rng = random.Random(8)
    texts = [t or "" for _, t in documents(tables)] + CASES + BESIDE + [mixed(rng) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = 0
    for r in secrets.spans(df, table).collect():
        want = markov(texts[r["doc_id"]], table)
        assert [(s["start"], s["end"]) for s in r["markov"]] == want, texts[r["doc_id"]][:200]
        found += len(want)
    assert found > 100


LONG = {
    "one run": "Ab3" * 350_000,
    "one random run": "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(1_000_000)),
    "many spans": "token=abcdef1 " * 20_000,
    "many runs and spans": "token=abcdef1 q7Zp2LxV9sKd4TnB1mYw8RfG " * 10_000,
    "many runs in a span": "token=" + "q7Zp2LxV9sKd4TnB1mYw8RfG." * 10_000,
}


@pytest.mark.parametrize("name", LONG)
def test_long_texts(spark, name):
    text = LONG[name]
    df = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    table = [0.0] * 6400
    secrets.spans(df.limit(0), table).collect()
    began = time.time()
    r = secrets.spans(df, table, 0.0).select("assign", "markov").collect()[0]
    assert time.time() - began < 20
    assert [(s["start"], s["end"]) for s in r["markov"]] == open_pieces(text) and len(r["assign"]) == sum(k == 0 for _, k, _ in base(text))
