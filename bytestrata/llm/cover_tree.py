"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors are compared on the unit sphere, where cosine c is the distance sqrt(2 - 2c). Equal vectors of a
label are one point with a multiplicity. A cover tree has nested levels: every level halves the radius, each
node is a point that covers its children within the radius, and it knows the largest distance to a point
below it. Two trees are traversed together, level by level: a pair of nodes whose distance exceeds the
threshold plus both covering radii is pruned with all that is below it; a pair that lies within the
threshold by both radii links all points below at once; pairs of single points are decided by their cosine
in double precision.

Labels of more than BLOCK points are cut into cells around pivots (at most PIVOTS of all labels together,
shared out by size), and cells that stand side by side in the cover tree of the pivots make blocks of at most BLOCK points,
or several blocks a cell. A point is sent to a block only if one of its cells can hold a linked point: the cell's covering
radius must reach it, and its distance to the plane between both pivots must be within the threshold, since a linked point is
on the other side. That holds at any number of pivots. A label whose share of the pivots is less than two is cut into blocks by
hash, which all meet. What leaves a task is a number of links per point and a spanning
forest, not the pairs.

Defined results: a vector that is null, empty or zero or has a null or non-finite component, or whose label is
null, links with nothing and is its own component; vectors of different length do not link; repeated rows are
rows of their own and link with each other; an empty table gives an empty result; other columns are ignored.
A null vec_id is never a component's name unless all of its vectors have none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bytestrata.llm.common import cut, pick, tidy
from bytestrata.llm.components import components

COSINE = 0.98
BLOCK, CELL, PIVOTS = 8192, 1024, 4096
#: Distances are compared with this slack before the cosine decides.
SLACK = 1e-7
_PAIRS = 1 << 18


@dataclass
class Tree:
    """levels[k]: points that are nodes of level k, the slice of their children in level k + 1, and their covering radii.

    Points are stored so that all points below a node are order[low:high].
    """

    points: np.ndarray
    nodes: list[np.ndarray]
    children: list[np.ndarray]
    radius: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    order: np.ndarray


def build(points: np.ndarray) -> Tree:
    """Cover tree of distinct points on the unit sphere; its last level has every point as a node."""
    n = len(points)
    groups = [(0, np.arange(n))] if n else []  # the node, and the points that it covers
    nodes, children, radius, members = [], [], [], []
    reach = 2.0
    while True:
        nodes.append(np.array([g[0] for g in groups], np.int64))
        radius.append(np.array([_far(points, c, own) for c, own in groups]))
        members.append([own for _, own in groups])
        if all(len(own) == 1 for _, own in groups):
            break
        reach /= 2
        below, first = [], [0]
        for center, own in groups:
            below += _cover(points, center, own, reach)
            first.append(len(below))
        children.append(np.array(first))
        groups = below
    # the last level's order puts the points below every node side by side
    order = np.concatenate(members[-1]) if n else np.zeros(0, np.int64)
    sizes = [np.array([len(m) for m in level], np.int64) for level in members]
    high = [np.cumsum(s) for s in sizes]
    return Tree(points, nodes, children, radius, [h - s for h, s in zip(high, sizes)], high, order)


def _far(points: np.ndarray, center: int, own: np.ndarray) -> float:
    if len(own) == 1:
        return 0.0
    return float(math.sqrt(max(0.0, 2 - 2 * (points[own] @ points[center]).min()))) + SLACK


def _cover(points: np.ndarray, center: int, own: np.ndarray, reach: float) -> list[tuple[int, np.ndarray]]:
    """Points as children (a point, what it covers within reach); the node itself is the first child."""
    if len(own) == 1 or reach < 1e-6:
        return [(int(i), np.array([i])) for i in own]
    out, near = [], 1 - reach * reach / 2
    while len(own):
        inside = points[own] @ points[center] >= near
        inside |= own == center
        out.append((int(center), own[inside]))
        own = own[~inside]
        if len(own):
            center = own[0]
    return out


def unite(top: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of the points i and j; top holds the least point of each one's component."""
    while len(i):
        x, y = top[i], top[j]
        apart = x != y
        if not apart.any():
            return
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (further := top[top]).tobytes() != top.tobytes():
            top[:] = further


def dual(a: Tree, b: Tree, same: bool, cosine: float, weight_a: np.ndarray, weight_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each point of a and of b, counted with the other's weights, and the least point of each one's component.

    In the components, the points of b come after those of a. With same, a and b are one tree, and so are their points.
    """
    limit = math.sqrt(2 - 2 * cosine)
    shift = 0 if same else len(a.points)
    count_a, count_b, top = np.zeros(len(a.points), np.int64), np.zeros(len(b.points), np.int64), np.arange(shift + len(b.points))
    total_a = np.concatenate(([0], np.cumsum(weight_a[a.order])))
    total_b = np.concatenate(([0], np.cumsum(weight_b[b.order])))
    if not len(a.points) or not len(b.points):
        return count_a, count_b, top
    depth = max(len(a.nodes), len(b.nodes))
    pairs = np.zeros((1, 2), np.int64)
    for level in range(depth):
        la, lb = min(level, len(a.nodes) - 1), min(level, len(b.nodes) - 1)
        one_a, one_b = a.high[la] - a.low[la] == 1, b.high[lb] - b.low[lb] == 1
        kept = []
        for i, j, dot in _evaluated(a, la, b, lb, pairs, same):
            d = np.sqrt(np.maximum(0, 2 - 2 * dot))
            ra, rb = a.radius[la][i], b.radius[lb][j]
            open_ = d <= limit + ra + rb + SLACK
            i, j, d, dot, ra, rb = (v[open_] for v in (i, j, d, dot, ra, rb))
            single = one_a[i] & one_b[j]
            apart = i != j if same else np.ones(len(i), bool)
            whole = ~single & (d + ra + rb < limit - SLACK) & apart
            for x, y in zip(i[whole].tolist(), j[whole].tolist()):
                xs, ys = a.order[a.low[la][x] : a.high[la][x]], b.order[b.low[lb][y] : b.high[lb][y]]
                count_a[xs] += total_b[b.high[lb][y]] - total_b[b.low[lb][y]]
                count_b[ys] += total_a[a.high[la][x]] - total_a[a.low[la][x]]
                every = np.concatenate((xs, ys + shift))
                unite(top, np.full(len(every), every[0]), every)
            hit = single & (dot >= cosine) & apart
            x, y = a.nodes[la][i[hit]], b.nodes[lb][j[hit]]
            count_a += np.bincount(x, weight_b[y], len(count_a)).astype(np.int64)
            count_b += np.bincount(y, weight_a[x], len(count_b)).astype(np.int64)
            unite(top, x, y + shift)
            rest = ~single & ~whole
            kept.append(np.stack((i[rest], j[rest]), 1))
        pairs = np.concatenate(kept) if kept else np.zeros((0, 2), np.int64)
        if not len(pairs):
            break
    if same:  # both points of a pair were counted on opposite sides
        count_a = count_b = count_a + count_b
    return count_a, count_b, top


def _evaluated(a: Tree, la: int, b: Tree, lb: int, pairs: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Node pairs of a level below the given pairs of the level above, with their inner products, in pieces."""
    if la == 0 and lb == 0:
        i = j = np.zeros(1, np.int64)
        yield i, j, (a.points[a.nodes[0]] * b.points[b.nodes[0]]).sum(1)
        return
    # of a tree that has ended, nodes of the last level stay their own children
    first_a = a.children[la - 1] if la == lb or la > lb else np.arange(len(a.nodes[la]) + 1)
    first_b = b.children[lb - 1] if la == lb or lb > la else np.arange(len(b.nodes[lb]) + 1)
    many_a, many_b = np.diff(first_a)[pairs[:, 0]], np.diff(first_b)[pairs[:, 1]]
    size = many_a * many_b
    large = size > 4096
    for x, y in pairs[large].tolist():
        js = np.arange(first_b[y], first_b[y + 1])
        right = b.points[b.nodes[lb][js]]
        step = max(1, _PAIRS // len(js))
        for p in range(first_a[x], first_a[x + 1], step):
            iss = np.arange(p, min(first_a[x + 1], p + step))
            dot = (a.points[a.nodes[la][iss]] @ right.T).ravel()
            i, j = np.repeat(iss, len(js)), np.tile(js, len(iss))
            keep = i <= j if same and x == y else slice(None)
            yield i[keep], j[keep], dot[keep]
    small = np.flatnonzero(~large)
    ends = np.cumsum(size[small])
    at = 0
    while at < len(small):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
        own = small[at:to]
        k = np.repeat(np.arange(len(own)), size[own])
        inner = np.arange(len(k)) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
        i = first_a[pairs[own, 0]][k] + inner // many_b[own][k]
        j = first_b[pairs[own, 1]][k] + inner % many_b[own][k]
        if same:
            keep = (pairs[own, 0] != pairs[own, 1])[k] | (i <= j)
            i, j = i[keep], j[keep]
        yield i, j, np.einsum("ij,ij->i", a.points[a.nodes[la][i]], b.points[b.nodes[lb][j]])
        at = to


def _points(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, unit): unit vectors in double precision; null where a vector links with nothing."""
    own = pick(vectors, "vec_id", "label", "embedding")
    value = F.col("embedding").cast("array<double>")
    own = own.withColumn("value", value)
    # scaled by the largest component first, so that squares neither overflow nor vanish
    bad = F.exists("value", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & (F.size("value") > 0) & ~F.coalesce(bad, F.lit(True))
    own = own.withColumn("most", F.when(usable, F.array_max(F.transform("value", F.abs))))
    own = own.withColumn("scaled", F.when(F.col("most") > 0, F.transform("value", lambda x: x / F.col("most"))))
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    own = own.withColumn("norm", norm)
    # -0.0 and 0.0 are one component
    return own.select("vec_id", "label", F.transform("scaled", lambda x: x / F.col("norm") + F.lit(0.0)).alias("unit"))


def _pivots(points: DataFrame) -> dict[tuple, np.ndarray]:
    """Pivots of the labels with more than BLOCK points: a bounded number of points in all, by their hash."""
    n = points.count()
    sizes = points.groupBy(F.col("label").alias("_label"), F.size("unit").alias("dims")).agg(F.count("*").alias("many")).filter(F.col("many") > BLOCK)
    # a label of m points gets up to m / CELL pivots, and all labels together at most PIVOTS
    wanted = F.least(F.ceil(F.col("many") / CELL), F.floor(F.lit(PIVOTS) * F.col("many") / max(n, 1))).cast("int")
    sizes = sizes.withColumn("wanted", wanted).filter("wanted > 1")
    near = points.join(sizes, (F.col("label") == F.col("_label")) & (F.size("unit") == F.col("dims")))
    share = F.pmod(F.xxhash64("point"), F.lit(1 << 30)) / float(1 << 30)
    near = near.filter(share < 4.0 * F.col("wanted") / F.col("many"))
    picked = F.array_sort(F.collect_list(F.struct(F.xxhash64("point").alias("h"), "point", "unit")))
    rows = near.groupBy("label", "dims", "wanted").agg(picked.alias("p")).select("label", "dims", F.expr("transform(slice(p, 1, wanted), x -> x.unit)").alias("p")).collect()
    return {(r["label"], r["dims"]): np.array(r["p"]) for r in rows}


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[object, int, np.ndarray, np.ndarray]]:
    """Label, dimensions, row numbers and vectors of the rows of one label and length, of a batch with columns label and unit."""
    units = batch.column(batch.schema.get_field_index("unit"))
    offsets, values = units.offsets.to_numpy().astype(np.int64), units.values.to_numpy()
    dims = np.diff(offsets)
    labels = batch.column(batch.schema.get_field_index("label")).dictionary_encode()
    key = labels.indices.to_numpy().astype(np.int64) * (int(dims.max(initial=0)) + 1) + dims
    names = labels.dictionary.to_pylist()
    for k in np.unique(key):
        rows = np.flatnonzero(key == k)
        wide = int(dims[rows[0]])
        yield names[labels.indices[int(rows[0])].as_py()], wide, rows, values[offsets[rows][:, None] + np.arange(wide)]


@dataclass
class Blocks:
    """The blocks of a label: for each cell its first block and how many it has; cells in the order of their blocks."""

    pivots: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    many: np.ndarray
    order: np.ndarray
    gap: np.ndarray

    @classmethod
    def of(cls, pivots: np.ndarray, sizes: np.ndarray, radius: np.ndarray) -> Blocks:
        order, first, many, at, held = build_order(pivots), np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64), -1, 0
        for cell in order:
            many[cell] = max(1, -(-int(sizes[cell]) // BLOCK))
            if at < 0 or held + sizes[cell] > BLOCK:
                at, held = at + 1, 0
            first[cell] = at
            held += sizes[cell]
            if many[cell] > 1:  # a cell with blocks of its own
                at, held = at + int(many[cell]) - 1, BLOCK
        gap = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))
        return cls(pivots, radius, first, many, order, gap)

    def reach(self, units: np.ndarray, cell: np.ndarray, limit: float) -> np.ndarray:
        """Matrix of the points and the blocks with a cell that can hold a point within the limit."""
        dots = units @ self.pivots.T
        own = dots[np.arange(len(units)), cell]
        near = own[:, None] - dots <= limit * self.gap[cell] + 1e-6
        near &= np.sqrt(np.maximum(0, 2 - 2 * dots)) <= self.radius[None, :] + limit + 1e-6
        near[np.arange(len(units)), cell] = True
        out = np.zeros((len(units), int((self.first + self.many).max())), bool)
        for c in range(len(self.pivots)):
            out[:, self.first[c] : self.first[c] + self.many[c]] |= near[:, c, None]
        return out


def build_order(pivots: np.ndarray) -> np.ndarray:
    """The points in the order of the leaves of their cover tree."""
    distinct, where = np.unique(pivots, axis=0, return_inverse=True)
    place = np.argsort(build(distinct).order)
    return np.argsort(place[where.ravel()], kind="stable")


def linked(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    limit = math.sqrt(2 - 2 * cosine)
    # equal vectors are told by 128 bits of hashes
    usable = F.col("unit").isNotNull()
    rows = cut(_points(vectors).withColumn("high", F.when(usable, F.xxhash64("label", "unit"))).withColumn("low", F.when(usable, F.xxhash64(F.lit(7), "unit", "label"))))
    points = rows.filter("high is not null").groupBy("high", "low").agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    points = cut(points.withColumn("point", F.monotonically_increasing_id()))
    pivots = _pivots(points)
    kind = dict(points.dtypes)["label"]

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for label, dims, at, units in _groups(batch):
                if (p := pivots.get((label, dims))) is not None:
                    dots = units @ p.T
                    cells[at] = dots.argmax(1)
                    away[at] = np.sqrt(np.maximum(0, 2 - 2 * dots.max(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(away)], ["label", "unit", "point", "weight", "cell", "away"])

    placed = points.select("label", "unit", "point", "weight").mapInArrow(tidy(cell), f"label {kind}, unit array<double>, point long, weight long, cell int, away double").withColumn("dims", F.size("unit"))
    blocks: dict[tuple, Blocks] = {}
    if pivots:
        placed = cut(placed)
        found: dict[tuple, list] = {}
        for r in placed.groupBy("label", "dims", "cell").agg(F.count("*").alias("many"), F.max("away").alias("away")).join(_named(points, pivots), ["label", "dims"], "left_semi").collect():
            found.setdefault((r["label"], r["dims"]), []).append((r["cell"], r["many"], r["away"]))
        for key, p in pivots.items():
            sizes, radius = np.zeros(len(p), np.int64), np.zeros(len(p))
            for c, many, away in found.get(key, []):
                sizes[c], radius[c] = many, away
            blocks[key] = Blocks.of(p, sizes, radius)

    large = points.groupBy("label", F.size("unit").alias("dims")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("splits")).filter("splits > 1")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, points_, splits = batch.column(4).to_numpy(), batch.column(2).to_numpy(), batch.column(5).to_numpy()
            for label, dims, at, units in _groups(batch):
                own, other, row = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
                if (b := blocks.get((label, dims))) is not None:
                    block = b.first[cells[at]] + points_[at] % b.many[cells[at]]
                    row, other = np.nonzero(b.reach(units, cells[at], limit))
                    own = block[row]
                elif (many := int(splits[at[0]])) > 1:
                    row, other = np.repeat(row, many), np.tile(np.arange(many), len(at))
                    own = (points_[at] % many)[row]
                side = np.where(own == other, 2, np.where(own < other, 0, 1))
                keep = batch.select(["label", "point", "weight", "unit"]).take(pa.array(at[row]))
                places = [pa.array(x.astype(np.int32)) for x in (np.minimum(own, other), np.maximum(own, other), side)]
                yield pa.RecordBatch.from_arrays([*places, *keep.columns], ["low", "high", "side", "label", "point", "weight", "unit"])

    placed = placed.join(large, ["label", "dims"], "left")
    sent = placed.select("label", "unit", "point", "weight", "cell", F.coalesce("splits", F.lit(1)).alias("splits")).mapInArrow(tidy(send), f"low int, high int, side int, label {kind}, point long, weight long, unit array<double>")
    task = F.concat_ws("|", F.col("label").cast("string"), F.size("unit").cast("string"), F.col("low").cast("string"), F.col("high").cast("string"))
    found = cut(_compared(sent.select(task.alias("task"), "side", "point", "weight", "unit"), cosine))
    counts = found.filter("links is not null").groupBy(F.col("a").alias("point")).agg(F.sum("links").alias("links"))
    joined = components(found.filter("links is null")).withColumnRenamed("node", "point")
    own = points.select("point", "high", "low", "weight", "least").join(counts, "point", "left").join(joined, "point", "left").withColumn("component", F.coalesce("component", "point"))
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    own = cut(own.join(least, "component").select("high", "low", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    out = rows.select("vec_id", "high", "low").join(own, ["high", "low"], "left")
    component = F.when(F.col("high").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("long")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id").cast("long")).alias("kept"))


def _named(points: DataFrame, pivots: dict) -> DataFrame:
    """(label, dims) of the labels with pivots: at most PIVOTS rows."""
    kind = dict(points.dtypes)["label"]
    return F.broadcast(points.sparkSession.createDataFrame(list(pivots), f"label {kind}, dims int"))


def _compared(sent: DataFrame, cosine: float) -> DataFrame:
    """(a, b, links): the number of links of point a in a task (b null), and the links of a spanning forest (links null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_numpy(zero_copy_only=False)
            side, point, weight = (batch.column(i).to_numpy() for i in (1, 2, 3))
            units = batch.column(4)
            starts = np.concatenate(([0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]))
            for a, b in zip(starts, starts[1:]):
                if names[a] != task:
                    yield out(held)
                    task, held = names[a], []
                held.append((side[a:b], point[a:b], weight[a:b], units.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)))
        yield out(held)

    def out(held: list[tuple]) -> pa.RecordBatch:
        a, b, n = [], [], []
        if held:
            side, names, weight, units = (np.concatenate(x) for x in zip(*held))
            if side[0] == 2:
                tree = build(units)
                count, _, top = dual(tree, tree, True, cosine, weight, weight)
                parts, every = [(names, count)], names
            else:
                l, r = side == 0, side == 1
                x, y, top = dual(build(units[l]), build(units[r]), False, cosine, weight[l], weight[r])
                parts, every = [(names[l], x), (names[r], y)], np.concatenate((names[l], names[r]))
            for own, count in parts:
                some = count > 0
                a += own[some].tolist()
                n += count[some].tolist()
            other = np.flatnonzero(top != np.arange(len(top)))
            b = [None] * len(a) + every[other].tolist()
            n += [None] * len(other)
            a += every[top[other]].tolist()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "links"])

    return sent.repartition("task").sortWithinPartitions("task").mapInArrow(tidy(run), "a long, b long, links long")


ORACLE = r"""
WITH RECURSIVE own AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT vec_id, label, e FROM own WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM own UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT o.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, c = o.vec_id AS kept
FROM own o LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = o.vec_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = o.vec_id
"""
