"""The two classifiers' queries against plain Python on the same rows: features, learning and scores."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
import xxhash

from bytestrata.llm import quality, queries, toxicity
from bytestrata.llm.common import span_hashes

ALL = (1 << 64) - 1


def mixed(h: int) -> int:
    for _ in range(2):
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 & ALL
    return h ^ h >> 32


def hashed(word: bytes) -> int:
    return int(span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0][0])


def learned(spark, folder: str, column: str) -> list[tuple[str, int]]:
    """Texts and labels of the documents that may be learned from, in the order of the hash of their ids."""
    labels: dict = {}
    for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
        if r["doc_id"] is not None and r[column] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            labels[r["doc_id"]] = max(int(r[column]), labels.get(r["doc_id"], 0))
    place = lambda i: xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    docs = [r for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r["doc_id"] in labels]
    return [(r["text"] or "", labels[r["doc_id"]]) for r in sorted(docs, key=lambda r: (signed(place(r["doc_id"])), r["doc_id"]))]


# --- toxicity


def coordinates(text: str) -> list[int]:
    words, own = [], b""
    for c in text.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) + b" ":
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            own += bytes([c])
        elif own:
            words.append(own)
            own = b""
    found = set()
    for w in words:
        found.add(hashed(w))
        for n in toxicity.PREFIXES:
            if len(w) > n:
                found.add(mixed(hashed(w[:n]) + n & ALL))
    for skip in (1, 2):
        for a, b in zip(words, words[skip:]):
            found.add(mixed(hashed(a) * 0x9E3779B97F4A7C15 + hashed(b) + skip & ALL))
    return sorted({f >> 64 - toxicity.BITS for f in found})


def ftrl(rows: list[tuple[list[int], int]]) -> tuple[dict[int, float], float]:
    """FTRL-proximal, one coordinate after the other."""
    z: dict[int, float] = {}
    n: dict[int, float] = {}

    def weight(i: int) -> float:
        own, l1 = z.get(i, 0.0), 0.0 if i < 0 else toxicity.L1
        if abs(own) <= l1:
            return 0.0
        return -(own - math.copysign(l1, own)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for own, y in rows:
            at = [*own, -1]
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w))))) - y
            for i, v in zip(at, w):
                had = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(had + g * g) - math.sqrt(had)) / toxicity.ALPHA * v
                n[i] = had + g * g
    return {i: v for i in z if i >= 0 and (v := weight(i))}, weight(-1)


def test_toxicity_query(spark, tables):
    weights, bias = ftrl([(coordinates(t), y) for t, y in learned(spark, tables, "toxic")])
    assert weights
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op9_toxicity"](spark, tables).collect()}
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        total = bias + sum(weights.get(i, 0.0) for i in coordinates(r["text"] or ""))
        assert abs(1 / (1 + math.exp(-total)) - got[r["doc_id"]]) < 1e-5


# --- quality


def plain_lines(text: str) -> tuple[list[list[float]], list[int]]:
    """Features of lines by their definition, with those of the line before and after, and the lines' bytes."""
    words = lambda line: [w for w in bytes(line).translate(bytes(32 if c in (9, 10, 11, 12, 13) else c for c in range(256))).split(b" ") if w]
    rows = [line for line in text.encode().split(b"\n") if words(line)]
    own = []
    for line in rows:
        w = words(line)
        letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
        symbol = lambda c: (33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126) and c not in (44, 46)
        share = lambda f: sum(map(f, line)) / len(line)
        own.append([
            share(letter), share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(lambda c: c == 124), share(symbol),
            sum(a == b for a, b in zip(w, w[1:])) / len(w), 1 - len(set(w)) / len(w), float(rows.count(line) > 1), float(line[-1] in b".?!"), math.log1p(len(w)) / 5, min(sum(map(len, w)) / len(w), 40) / 10,
        ])
    zero = [0.0] * 11
    out = [f + (own[i - 1] if i else zero) + (own[i + 1] if i + 1 < len(own) else zero) + [1.0, float(i == 0), float(i + 1 == len(own))] for i, f in enumerate(own)]
    return out, [len(line) for line in rows]


ODD = ["", "\n \n", "one line.", "A b\nA b\n\n||| 12 12 12 ?\r\nlast", "Größe 3 %\tx\n" * 4 + "end!", "x" * 300 + "\ny y y y"]


def test_quality_features(spark, tables):
    for text in ODD + [r["text"] or "" for r in spark.read.parquet(f"{tables}/documents.parquet").limit(100).collect()]:
        buf = np.frombuffer(text.encode(), np.uint8)
        x, length, first = quality.lines(buf, np.array([0, len(buf)]))
        want, sizes = plain_lines(text)
        assert first.tolist() == [0, len(want)] and length.tolist() == sizes
        assert np.allclose(x, np.array(want).reshape(-1, quality.WIDTH))


def chain(emit: list[float], ties: np.ndarray) -> list[float]:
    """Marginals of good by products of scaled messages."""
    n = len(emit)
    t = np.exp(ties)
    forward, backward = [np.array([1.0, math.exp(emit[0])])], [np.ones(2)]
    for e in emit[1:]:
        m = (forward[-1] / forward[-1].sum()) @ t * np.array([1.0, math.exp(e)])
        forward.append(m)
    for e in reversed(emit[1:]):
        m = t @ (np.array([1.0, math.exp(e)]) * backward[-1])
        backward.append(m / m.sum())
    both = [f * b for f, b in zip(forward, reversed(backward))]
    return [float(b[1] / b.sum()) for b in both] if n else []


def test_quality_query(spark, tables):
    rows = learned(spark, tables, "quality")
    x = [plain_lines(t) for t, _ in rows]
    first = np.concatenate(([0], np.cumsum([len(f) for f, _ in x])))
    field = quality.fit(np.array([f for own, _ in x for f in own]), first, np.array([y for _, y in rows], float))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in queries.QUERIES["op5_quality"](spark, tables).collect()}
    for r in spark.read.parquet(f"{tables}/documents.parquet").collect():
        f, sizes = plain_lines(r["text"] or "")
        good = chain((np.array(f).reshape(-1, quality.WIDTH) @ field.weights).tolist(), field.ties) if f else []
        want = sum(g * s for g, s in zip(good, sizes)) / sum(sizes) if f else field.prior
        score, predicted = got[r["doc_id"]]
        assert abs(score - want) < 1e-6 and predicted == int(score >= 0.3)


def test_quality_gradient():
    """The fit's gradient is that of the likelihood, by differences."""
    rng = np.random.default_rng(4)
    x, first, y = rng.normal(size=(9, 3)), np.array([0, 4, 5, 9]), np.array([1.0] * 4 + [0.0] + [1.0] * 4)

    def likelihood(w: np.ndarray, ties: np.ndarray) -> float:
        emit = x @ w
        _, _, z = quality.forward_backward(emit, first, ties)
        inner = [i for i in range(9) if i not in first]
        return float((emit * y).sum() + sum(ties[int(y[i - 1]), int(y[i])] for i in inner) - z.sum())

    w, ties = rng.normal(size=3), rng.normal(size=(2, 2))
    good, moved, _ = quality.forward_backward(x @ w, first, ties)
    assert np.allclose(x.T @ (y - good), [(likelihood(w + d, ties) - likelihood(w - d, ties)) / 2e-6 for d in np.eye(3) * 1e-6], atol=1e-4)
    stay = np.array([[0.0, 0.0], [0.0, 6.0]])
    step = [(likelihood(w, ties + d.reshape(2, 2)) - likelihood(w, ties - d.reshape(2, 2))) / 2e-6 for d in np.eye(4) * 1e-6]
    assert np.allclose((stay - moved).ravel(), step, atol=1e-4)
