"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and bytes above 0x7F, in lower case. A document's features are its
distinct words, word pairs, pairs that skip one word, and the first bytes of its longer words (so that
stems count in words that were not seen), hashed into 2^BITS coordinates. Learning rates are per
coordinate, and the L1 term keeps most weights at zero: what the executors get is the short list of
the others. The model is learned in one task from a sample of at most LEARN labelled documents.

Defined results: a null text is the empty text, which has no features and gets the score of the intercept
alone; repeated rows get equal scores; a null doc_id counts as held out; without labels every weight is 0
and every score 0.5; an empty table gives an empty result; other columns are ignored. Whole texts are
scored, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bytestrata.llm.common import _LOWER, U64, carried, held_out, learning_rows, mix, pick, span_hashes, spans, steps, tidy

BITS = 20
#: Labelled documents to learn from, at most.
LEARN = 8192
PREFIXES = (4, 5, 7)
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 10.0, 1.0, 3
THRESHOLD = 0.5

_INSIDE = np.zeros(256, bool)
_INSIDE[128:] = True
_INSIDE[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)] = True


def features(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all features, and the row of each one; a row's coordinates may repeat."""
    buf = _LOWER[buf]
    starts, ends, first = spans(_INSIDE[buf], offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    longer = [ends - starts > n for n in PREFIXES]
    words, *stems = span_hashes(buf, starts, ends, *(np.minimum(ends, starts + n) for n in PREFIXES))
    with np.errstate(over="ignore"):
        found, whose = [words], [rows]
        for n, s, keep in zip(PREFIXES, stems, longer):
            found.append(mix(s[keep] + U64(n)))
            whose.append(rows[keep])
        for skip in (1, 2):
            keep = rows[:-skip] == rows[skip:]
            found.append(mix(words[:-skip] * U64(0x9E3779B97F4A7C15) + words[skip:] + U64(skip))[keep])
            whose.append(rows[:-skip][keep])
    return (np.concatenate(found) >> U64(64 - bits)).astype(np.int64), np.concatenate(whose)


@dataclass
class Model:
    """Coordinates with a weight other than 0, their weights, and the intercept."""

    at: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self, bits: int = BITS) -> np.ndarray:
        out = np.zeros(1 << bits, np.float32)
        out[self.at] = self.weights
        return out

    def scores(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
        at, rows = features(buf, offsets)
        some = np.flatnonzero(table[at])
        pairs = np.unique(rows[some] << BITS | at[some])
        total = np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)].astype(float), len(offsets) - 1)
        return 1 / (1 + np.exp(-(total + self.bias)))


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """Learns from the distinct coordinates of each document, in the given order."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = np.array([1 << bits])
    weight = lambda a, l1: np.where(np.abs(z[a]) <= l1, 0.0, -(z[a] - np.sign(z[a]) * l1) / ((BETA + np.sqrt(n[a])) / ALPHA + L2))
    for _ in range(epochs):
        for own, y in zip(rows, labels):
            at = np.concatenate((own, bias))
            w = weight(at, L1)
            w[-1] = weight(bias, 0.0)[0]
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(1 << bits), L1)
    at = np.flatnonzero(w)
    return Model(at, w[at], float(weight(bias, 0.0)[0]))


def learn(docs: DataFrame, labels: DataFrame, most: int = LEARN) -> Model:
    """Learns in one task from a bounded sample; only weights other than 0 come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, marks = [], []
        for batch in batches:
            for part, buf, offsets in steps(batch, "text"):
                at, whose = features(buf, offsets)
                pairs = np.unique(whose << BITS | at)
                cuts = np.searchsorted(pairs >> BITS, np.arange(part.num_rows + 1))
                at = (pairs & ((1 << BITS) - 1)).astype(np.int32)
                rows += [at[a:b] for a, b in zip(cuts, cuts[1:])]
                marks += part.column(1).to_pylist()
        model = fit(rows, np.array(marks, float)) if rows else Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([*model.at.tolist(), -1], pa.int64()), pa.array([*model.weights.tolist(), model.bias], pa.float64())], ["at", "weight"])

    got = learning_rows(docs, labels, "toxic", most).coalesce(1).mapInArrow(tidy(run), "at long, weight double").toPandas()
    own = got[got["at"] >= 0]
    return Model(own["at"].to_numpy(np.int64), own["weight"].to_numpy(float), float(got.loc[got["at"] < 0, "weight"].sum()))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and score, 0 to 1, of every whole text."""
    own = pick(docs, "text", *(c for c in keep if c != "text"))
    kinds = dict(own.dtypes)
    where = {n: i for i, n in enumerate(own.columns) if n in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            for part, buf, offsets in steps(batch, "text"):
                yield pa.RecordBatch.from_arrays([*map(part.column, where.values()), pa.array(model.scores(buf, offsets, table))], [*where, "score"])

    return own.mapInArrow(tidy(run), ", ".join(f"`{n}` {kinds[n]}" for n in where) + ", score double")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns. Without labels none is known to be toxic, and all stay."""
    own, back = carried(docs, "doc_id", "text")
    model = learn(own, labels)
    if not len(model.at) and model.bias == 0.0:
        return docs
    return back(score(own, model, tuple(own.columns)).filter(F.col("score") < threshold))
