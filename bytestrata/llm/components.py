"""Connected components of links that never meet in one task or on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bytestrata.llm.common import cut, tidy


def forest(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links of a spanning forest: (least, other) for every node that is not the least of its tree."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(root(x), x) for x in list(up) if root(x) != x]


def thinned(links: DataFrame) -> DataFrame:
    """Each task's links (a long, b long) as a spanning forest, so that a dense group leaves few of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for batch in batches:
            pairs = np.unique(np.stack((batch.column(0).to_numpy(), batch.column(1).to_numpy()), 1), axis=0)
            held = forest([*held, *map(tuple, pairs.tolist())])
            if len(held) > 1_000_000:  # what a task holds is bounded; more rounds do the rest
                yield out(held)
                held = []
        yield out(held)

    def out(held: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in held], pa.int64()), pa.array([b for _, b in held], pa.int64())], ["a", "b"])

    return links.select("a", "b").mapInArrow(tidy(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that links (a long, b long) reach from each node that has one.

    In each round every node points to its least neighbour, pointers are shortened, and the links are drawn
    between what their ends point to; each component at least halves. All rounds are joins and partial
    aggregates, checkpointed, until no links are left.
    """
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    rounds = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("top")).withColumn("top", F.least("node", "top")))
        for _ in range(2):
            up = _followed(up, up)
        up = cut(up)
        rounds.append(up)
        ends = links
        for end in ("a", "b"):
            ends = ends.join(up.select(F.col("node").alias(end), F.col("top").alias(f"{end}_top")), end)
        links = cut(ends.select(F.least("a_top", "b_top").alias("a"), F.greatest("a_top", "b_top").alias("b")).filter("a < b").distinct())
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[0]
    for up in rounds[1:]:
        found = _followed(found, up)
    return found.select("node", F.col("top").alias("component"))


def _followed(found: DataFrame, up: DataFrame) -> DataFrame:
    """Each node's pointer, carried on by the pointer of what it points to."""
    further = up.select(F.col("node").alias("_at"), F.col("top").alias("_top"))
    return found.join(further, found["top"] == further["_at"], "left").select("node", F.coalesce("_top", "top").alias("top"))
