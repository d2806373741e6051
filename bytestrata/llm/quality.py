"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line that has a word is good or bad. A line's potential is linear in features of the line and of its
neighbours (shares of letters, capitals, digits and symbols, words that repeat, lines that repeat, and so
on); transitions tie neighbouring lines together. Forward-backward gives each line's marginal probability
of being good, and a document's score is their mean, weighted by the lines' lengths. The field is fitted by
gradient ascent on the likelihood of lines that carry their document's label, in one task, from a sample of
at most LEARN labelled documents.

Defined results: a null text is the empty text; a text without words has no lines and scores the share of
label 1 among the rows learned from; repeated rows get equal scores; a null doc_id counts as held out;
without labels all scores are 0.5; an empty table gives an empty result; other columns are ignored. Whole
texts are scored, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bytestrata.llm.common import U64, held_out, learning_rows, mix, pick, span_hashes, spans, steps, _SEPARATOR, tidy

#: Labelled documents to learn from, at most.
LEARN = 4096
THRESHOLD = 0.3
RATE, ROUNDS, SHRINK = 0.1, 120, 1e-3

_KIND = np.zeros((256, 6), bool)  # letter, capital, digit, bar, symbol, space
_KIND[np.r_[65:91, 97:123, 128:256], 0] = True
_KIND[65:91, 1] = True
_KIND[48:58, 2] = True
_KIND[124, 3] = True
_KIND[np.r_[33:48, 58:65, 91:97, 123:127], 4] = True
_KIND[[44, 46], 4] = False
_KIND[:, 5] = _SEPARATOR
_OWN = 11
WIDTH = 3 * _OWN + 3


def lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a word, their lengths in bytes, and the first line of each row (with the end)."""
    starts, ends, first = spans(buf != 10, offsets)
    word_starts, word_ends, _ = spans(~_SEPARATOR[buf], offsets)
    in_line = np.searchsorted(starts, word_starts, "right") - 1
    count = np.bincount(in_line, minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
    some = count > 0
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[some]
    renamed = np.cumsum(some) - 1
    starts, ends, count, in_line = starts[some], ends[some], count[some].astype(float), renamed[in_line]
    n = len(starts)
    own = np.zeros((n, _OWN))
    if n:
        length = (ends - starts).astype(float)
        for k in range(5):
            total = np.concatenate(([0], np.cumsum(_KIND[buf, k], dtype=np.int32)))
            own[:, k] = (total[ends] - total[starts]) / length
        words = span_hashes(buf, word_starts, word_ends)[0]
        same = np.zeros(len(words))
        same[1:] = (words[1:] == words[:-1]) & (in_line[1:] == in_line[:-1])
        own[:, 5] = np.bincount(in_line, same, n) / count
        with np.errstate(over="ignore"):
            distinct = np.unique(mix(words + in_line.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
            content = span_hashes(buf, starts, ends)[0] + rows.astype(U64) * U64(0xD6E8FEB86659FD93)
        own[:, 6] = 1 - np.bincount(in_line[distinct], minlength=n) / count
        _, back, times = np.unique(content, return_inverse=True, return_counts=True)
        own[:, 7] = times[back] > 1
        own[:, 8] = np.isin(buf[ends - 1], np.frombuffer(b".?!", np.uint8))
        own[:, 9] = np.log1p(count) / 5
        own[:, 10] = np.minimum(np.bincount(in_line, word_ends - word_starts, n) / count, 40) / 10
    else:
        length = np.zeros(0)
    row_first = np.searchsorted(rows, np.arange(len(offsets)))
    out = np.zeros((n, WIDTH))
    out[:, :_OWN] = own
    if n:
        tied = rows[1:] == rows[:-1]
        out[1:, _OWN : 2 * _OWN][tied] = own[:-1][tied]
        out[:-1, 2 * _OWN : 3 * _OWN][tied] = own[1:][tied]
        out[:, -3] = 1
        out[1:, -2] = ~tied
        out[0, -2] = 1
        out[:-1, -1] = ~tied
        out[-1, -1] = 1
    return out, length, row_first


def forward_backward(emit: np.ndarray, first: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal probability of good per line, expected transitions (2, 2), and log partition per row with lines.

    emit is the log potential of good, that of bad is 0. All rows advance together, longest first.
    """
    n, length = len(emit), np.diff(first)
    order = np.argsort(-length, kind="stable")
    long = length[order]
    e = np.stack((np.zeros(n), emit), 1)
    a, b = e.copy(), np.zeros((n, 2))
    heads, tails = first[:-1][order], first[1:][order] - 1
    active = np.searchsorted(-long, -np.arange(1, (long[0] if len(long) else 0) + 1), "right")
    for t in range(1, len(active)):
        at = heads[: active[t]] + t
        p = a[at - 1]
        a[at] += np.logaddexp(p[:, :1] + ties[0], p[:, 1:] + ties[1])
        at = tails[: active[t]] - t
        q = e[at + 1] + b[at + 1]
        b[at] = np.logaddexp(q[:, :1] + ties[:, 0], q[:, 1:] + ties[:, 1])
    has = length > 0
    z = np.logaddexp(*a[first[1:][has] - 1].T)
    every = np.repeat(z, length[has])
    good = np.exp(a[:, 1] + b[:, 1] - every)
    inner = np.ones(n, bool)
    inner[first[:-1][has]] = False
    at = np.flatnonzero(inner)
    moved = np.array([[np.exp(a[at - 1, i] + ties[i, j] + e[at, j] + b[at, j] - every[at]).sum() for j in (0, 1)] for i in (0, 1)])
    return np.clip(good, 0, 1), moved, z


@dataclass
class Field:
    weights: np.ndarray
    ties: np.ndarray
    prior: float

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, length, first = lines(buf, offsets)
        good, _, _ = forward_backward(x @ self.weights, first, self.ties)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        weight = np.bincount(rows, length, len(offsets) - 1)
        total = np.bincount(rows, good * length, len(offsets) - 1)
        return np.where(weight > 0, total / np.maximum(weight, 1), self.prior)


def fit(x: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Adam on the mean log-likelihood of lines labelled as their documents."""
    y = np.repeat(labels, np.diff(first)).astype(float)
    inner = np.ones(len(y), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    stay = np.diag([float((inner & (y == 0)).sum()), float((inner & (y == 1)).sum())])
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    many = max(1, len(labels))
    for t in range(1, rounds + 1):
        good, moved, _ = forward_backward(x @ theta[:WIDTH], first, theta[WIDTH:].reshape(2, 2))
        g = np.concatenate((x.T @ (y - good), (stay - moved).ravel())) / many - SHRINK * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Field(theta[:WIDTH], theta[WIDTH:].reshape(2, 2), float(labels.mean()) if len(labels) else 0.5)


def learn(docs: DataFrame, labels: DataFrame, most: int = LEARN) -> Field:
    """Fits the field in one task from a bounded sample; some forty numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, sizes, marks = [np.zeros((0, WIDTH))], [], []
        for batch in batches:
            for part, buf, offsets in steps(batch, "text"):
                own, _, first = lines(buf, offsets)
                x.append(own)
                sizes += np.diff(first).tolist()
                marks += part.column(1).to_pylist()
        field = fit(np.concatenate(x), np.concatenate(([0], np.cumsum(np.array(sizes, np.int64)))), np.array(marks, float))
        values = [*field.weights.tolist(), *field.ties.ravel().tolist(), field.prior]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["at", "value"])

    got = learning_rows(docs, labels, "quality", most).coalesce(1).mapInArrow(tidy(run), "at int, value double").toPandas().sort_values("at")["value"].to_numpy()
    if not len(got):
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), 0.5)
    return Field(got[:WIDTH], got[WIDTH : WIDTH + 4].reshape(2, 2), float(got[-1]))


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and score, 0 to 1, of every whole text."""
    own = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in steps(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(field.scores(buf, offsets))], ["doc_id", "score"])

    return own.mapInArrow(tidy(run), f"doc_id {own.dtypes[0][1]}, score double")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
