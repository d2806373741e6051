"""N-gram Jaccard join by PartEnum signatures, exact.

A document's set holds the 64-bit hashes of its distinct word shingles. Sets whose Jaccard similarity
reaches s differ in at most (1 - s) / (1 + s) of the sum of their sizes. Sizes fall into bands whose ends
have the ratio s, so that similar sets stand in one band or in neighbouring ones, and every set takes part in
two instances of neighbouring bands. An instance divides the domain of hashes into first-level parts, so many
that two similar sets differ by at most LEVEL elements in `spare` of them at least, and each of these into SUBPARTS
second-level parts: at most LEVEL of them differ, so that some subset of the others is equal. The hash
of a set's elements in such a subset is a signature, and similar sets share one in each of the spare parts.

A signature of too few elements would be shared by very many sets, and is not sent. Where fewer than `spare` parts of a
set have one, some signature that it shares with a similar set is still sent. Otherwise both sets have that many parts
with a weak signature, and both also send the signatures of an independent division of the domain, once: signatures
are added, not multiplied. Of the last of DIVISIONS divisions weak signatures are sent too, so that no pair is lost. The
shape is the same at any number of documents.

Sets with a common signature are candidates: stars around one of them. A star's links are ruled out by the counts of
elements by cell, which differ by no more than similar sets' may, and a spanning forest of those that are left is compared
element by element. What that connects are parts. Where stars around one part have sets of several, those outside of the part
with most of their sets are compared by counts with each other and with that part, so that what stands by chance in one
signature does not chain dissimilar sets together; the links of that are compared exactly too. Only where a component of candidates is then still in
several parts, the sets outside the largest part are compared exactly with each other and with the largest part, in blocks
of bounded size; only spanning forests of links leave a task. Equal sets are one set throughout, so copies cost nothing.

What is shuffled: packed signatures by range of their value, 40 bits of each beside the range, and 16 bits for the set. A
range is read as a stream and holds one entry for each signature, however many sets share it.

Defined results: a null text is the empty text; a text without words has an empty set and is linked with
nothing; a text of fewer words than a shingle has its whole sequence as one; ties and repeated rows are copies,
linked by their equal sets; a null doc_id is never a component's name unless all of its documents have none;
an empty table gives an empty result; other columns are ignored. Sets are told apart by 128-bit hashes, and their
elements are compared by 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bytestrata.llm.common import U64, carried, cut, discard, gather, mix, partitions, pick, release, shingle_hashes, steps, tidy, word_hashes
from bytestrata.llm.components import components

WORDS, PERCENT = 4, 85
#: Differences allowed in a first-level part, second-level parts, and independent divisions of the domain.
LEVEL, SUBPARTS, DIVISIONS = 1, 4, 4
#: Parts beyond the least number, as a share of it, once it is MANY_PARTS.
SPARE, MANY_PARTS = 0.035, 8
#: The most sets and elements of a block, about.
BLOCK_SETS, BLOCK_ELEMENTS = 256, 2_000_000
#: Entries that a task packs at once, sets that they can come from, and entries of a range.
HELD, HELD_SETS, RANGE = 1_000_000, 1 << 16, 1 << 21
#: Links that a task holds before it sends them, about.
LINKS = 1 << 20
#: Sets whose links one task thins, about.
SPANNED = 512
#: Elements of a set for each cell of its count vector, about.
PER_CELL = 4
_NAME = 0x9E3779B97F4A7C15
_LOW40 = U64((1 << 40) - 1)


def least_elements(percent: int) -> int:
    """Elements of the smallest signature that is not weak. Signatures of lower similarities have fewer elements."""
    return 2 if percent >= 85 else 1


def document_sets(texts: pa.RecordBatch, words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch with column text, with the ascending distinct shingle hashes of each row."""
    for part, buf, offsets in steps(texts, "text"):
        hashes, first = shingle_hashes(*word_hashes(buf, offsets, lower=True), words)
        yield part, [np.unique(hashes[a:b]) for a, b in zip(first, first[1:])]


def set_name(elements: np.ndarray) -> tuple[int, int]:
    """128-bit name of a set, as two signed numbers."""
    with np.errstate(over="ignore"):
        size = U64(len(elements)) * U64(_NAME)
        sums = np.array([mix(elements).sum(dtype=U64), mix(elements ^ U64(_NAME)).sum(dtype=U64)], U64) + size
        high, low = mix(sums).view(np.int64).tolist()
    return high, low


def band(size: int, percent: int) -> int:
    """Bands end at percent-ths of each other: sizes a <= b with 100 * a >= percent * b are in one band or the next."""
    return int(math.log(size) / math.log(100 / percent) + 1e-9) if size else -1


class Signatures:
    """The signatures of sets for one similarity."""

    def __init__(self, percent: int, level: int = LEVEL, subparts: int = SUBPARTS) -> None:
        self.percent, self.level, self.subparts, self.least = percent, level, subparts, least_elements(percent)
        self.subsets = np.zeros((subparts, math.comb(subparts, level)), np.int64)
        for column, kept in enumerate(combinations(range(subparts), subparts - level)):
            self.subsets[list(kept), column] = 1
        self.plans: dict[tuple[int, int], tuple[int, int, np.ndarray, np.ndarray] | None] = {}

    def plan(self, instance: int, division: int = 0) -> tuple[int, int, np.ndarray, np.ndarray] | None:
        """First-level parts and spare ones, bounds of second-level parts, and salts; None where similar sets are equal.

        In an instance, sets of its band meet those of the band below, and these each other; a pair's sizes add up to no
        more than the largest of both bands.
        """
        if (instance, division) not in self.plans:
            largest = lambda i: int((100 / self.percent) ** (i + 1) * (1 + 1e-9))
            apart = (largest(instance - 1) + largest(instance)) * (100 - self.percent) // (100 + self.percent)
            bad = apart // (self.level + 1)
            spare = 1 if bad < MANY_PARTS else 2 + math.ceil(SPARE * bad)
            many = bad + spare
            cells = many * self.subparts
            bounds = np.array([(i << 64) // cells for i in range(1, cells)], U64)
            salts = np.arange(1, many * self.subsets.shape[1] + 1, dtype=U64)
            with np.errstate(over="ignore"):
                salts = mix(salts + U64(division << 56) + U64((instance + 1) << 40)).reshape(many, -1)
            self.plans[instance, division] = (many, spare, bounds, salts) if apart else None
        return self.plans[instance, division]

    def of(self, elements: np.ndarray) -> np.ndarray:
        """All signatures that are sent of a set that is not empty, given in ascending order."""
        own, out, orders = band(len(elements), self.percent), [np.zeros(0, U64)], [elements]
        for instance in (own, own + 1):
            for division in range(DIVISIONS):
                plan = self.plan(instance, division)
                if plan is None:
                    break
                if division == len(orders):
                    with np.errstate(over="ignore"):
                        orders.append(np.sort(mix(elements * U64(2 * division + 1) + U64(division))))
                found, weak = self._plain(orders[division], plan)
                short = np.count_nonzero(weak.any(1)) >= plan[1]
                out.append(found.ravel() if short and division == DIVISIONS - 1 else found[~weak])
                if not short:
                    break
        return np.concatenate(out)

    def _plain(self, elements: np.ndarray, plan: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Signatures by first-level part, and which of them are weak."""
        many, _, bounds, salts = plan
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(elements + U64(1)), dtype=U64)))
            at = np.concatenate(([0], np.searchsorted(elements, bounds), [len(elements)]))
            cells = (sums[at[1:]] - sums[at[:-1]]).reshape(many, self.subparts)
            size = np.diff(at).reshape(many, self.subparts)
            return mix(cells @ self.subsets.astype(U64) + salts), size @ self.subsets < self.least


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of common elements of each set of the left and each of the right."""
    n, m = len(left), len(right)
    values, owner = np.concatenate(right), np.repeat(np.arange(m), [len(s) for s in right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    mine, whose = np.concatenate(left), np.repeat(np.arange(n), [len(s) for s in left])
    low = np.searchsorted(values, mine, "left")
    many = np.searchsorted(values, mine, "right") - low
    some = many > 0
    mine, whose, low, many = mine[some], whose[some], low[some], many[some]
    names = np.unique(mine)
    if float(many.sum()) * 15 > len(names) * float(n) * m / 10:  # dense: columns in matrices
        out = np.zeros((n, m), np.float32)
        at, theirs = np.searchsorted(names, mine), np.searchsorted(names, values)
        known = theirs < len(names)
        known[known] &= names[theirs[known]] == values[known]
        theirs, owner = theirs[known], owner[known]
        order = np.argsort(at, kind="stable")
        at, whose = at[order], whose[order]
        for a in range(0, len(names), wide := max(64, (1 << 23) // max(n, m))):
            x, y = np.zeros((n, wide), np.float32), np.zeros((m, wide), np.float32)
            i, j = np.searchsorted(at, (a, a + wide))
            x[whose[i:j], at[i:j] - a] = 1
            i, j = np.searchsorted(theirs, (a, a + wide))
            y[owner[i:j], theirs[i:j] - a] = 1
            out += x @ y.T
        return out.astype(np.int64)
    out, ends, a = np.zeros(n * m, np.int64), np.cumsum(many), 0
    while a < len(mine):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + max(1 << 21, n * m), "right")))
        key = np.repeat(whose[a:b] * m, many[a:b]) + owner[gather(low[a:b], many[a:b])]
        out += np.bincount(key, minlength=n * m)
        a = b
    return out.reshape(n, m)


def similar(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of the similar pairs of a set of the left and one of the right."""
    shared = common(left, right)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - shared
    return 100 * shared >= percent * union


def tree(found: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of a symmetric matrix of links."""
    todo, out = np.ones(len(found), bool), []
    for start in np.flatnonzero(found.any(1)):
        if not todo[start]:
            continue
        todo[start] = False
        stack = [start]
        while stack:
            at = stack.pop()
            more = np.flatnonzero(found[at] & todo)
            todo[more] = False
            out += [(at, x) for x in more]
            stack += more.tolist()
    return out


# --- sets and their counts -------------------------------------------------


def cell_counts(elements: np.ndarray) -> bytes:
    """Elements by cell, 255 at most. Cells are a power of two, so that vectors of different lengths fold onto each other."""
    cells = 1 << max(4, (len(elements) // PER_CELL).bit_length())
    return np.minimum(np.bincount((elements & U64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def folded(counts: bytes, cells: int) -> np.ndarray:
    return np.frombuffer(counts, np.uint8).reshape(-1, cells).sum(0, dtype=np.int32)


def maybe(left: list[bytes], left_n: np.ndarray, right: list[bytes], right_n: np.ndarray, percent: int) -> np.ndarray:
    """Matrix of the pairs whose counts leave it possible that they are similar.

    The counts of two sets differ by no more, in sum, than the sets do, and clipped or folded counts by no more than counts.
    """
    cells = min(map(len, left + right))
    x, y = np.stack([folded(c, cells) for c in left]), np.stack([folded(c, cells) for c in right])
    out = np.zeros((len(x), len(y)), bool)
    step = max(1, (1 << 22) // y.size)
    for a in range(0, len(x), step):
        apart = np.abs(x[a : a + step, None, :] - y[None, :, :]).sum(2)
        n, m = left_n[a : a + step, None], right_n[None, :]
        out[a : a + step] = (apart * (100 + percent) <= (n + m) * (100 - percent)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    return out


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, high and low (the set's name, null for the empty set) and counts of every document."""
    own = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in document_sets(batch, words):
                names = [set_name(s) if len(s) else (None, None) for s in sets]
                counts = pa.array([cell_counts(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([n[0] for n in names], pa.int64()), pa.array([n[1] for n in names], pa.int64()), counts], ["doc_id", "n_shingles", "high", "low", "counts"])

    return own.mapInArrow(tidy(run), f"doc_id {own.dtypes[0][1]}, n_shingles long, high long, low long, counts binary")


# --- candidates ------------------------------------------------------------


def packed(payload: np.ndarray) -> bytes:
    """Ascending 40-bit numbers: the lower 32 bits of each after how many have each value of the upper 8, or all 5 bytes of a few."""
    if len(payload) < 512:
        return payload.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return np.bincount((payload >> U64(32)).astype(np.int64), minlength=256).astype("<u4").tobytes() + payload.astype("<u4").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    if n < 512:
        out = np.zeros((n, 8), np.uint8)
        out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
        return out.view("<u8").ravel().astype(U64)
    high = np.repeat(np.arange(256, dtype=U64), np.frombuffer(data, "<u4", 256))
    return high << U64(32) | np.frombuffer(data, "<u4", offset=1024).astype(U64)


def sent(docs: DataFrame, words: int, percent: int, ranges: int) -> DataFrame:
    """(range, pack, signatures, sets): signatures of a range of a pack of sets, and the place in the pack of the set of each.

    One more row of each pack, without signatures, has the names of its sets. A task packs a set once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, seen = Signatures(percent), set()
        names, found, held = [], [], 0
        for batch in batches:
            for _, sets in document_sets(batch, words):
                for s in sets:
                    if len(s) and (name := set_name(s)) not in seen:
                        seen.add(name)
                        own = maker.of(s)
                        if len(own):
                            names.append(name)
                            found.append(own)
                            held += len(own)
                        if held >= HELD or len(names) == HELD_SETS:
                            yield out(names, found)
                            names, found, held = [], [], 0
            if len(seen) > 1_000_000:  # copies that come later are sent again, and meet their like by signature
                seen.clear()
        if names:
            yield out(names, found)

    def out(names: list[tuple[int, int]], found: list[np.ndarray]) -> pa.RecordBatch:
        place = np.repeat(np.arange(len(found)), [len(f) for f in found]).astype("<u2")
        every = np.concatenate(found)
        key = ((every >> U64(32)) * U64(ranges) >> U64(32)) << U64(40) | every & _LOW40
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        at = (key >> U64(40)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        ends = np.append(starts[1:], len(at))
        listed = np.array(names, np.int64)
        with np.errstate(over="ignore"):
            pack = int((mix(listed.view(U64).ravel()[: 2 * len(names)]) * np.arange(1, 2 * len(names) + 1, dtype=U64)).sum(dtype=U64) >> U64(17))
        slices = [packed(key[a:b] & _LOW40) for a, b in zip(starts, ends)]
        sets = [place[a:b].tobytes() for a, b in zip(starts, ends)]
        rows = len(slices) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array([*at[starts].tolist(), pack % ranges], pa.int32()), pa.array([pack] * rows, pa.int64()), pa.array([*slices, None], pa.binary()), pa.array([*sets, listed.tobytes()], pa.binary())],
            ["range", "pack", "signatures", "sets"],
        )

    return pick(docs, "text").mapInArrow(tidy(run), "range int, pack long, signatures binary, sets binary")


def distinct_links(a: np.ndarray, b: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each link once, many if any of its rows is."""
    order = np.lexsort((~many, b, a))
    a, b, many = a[order], b[order], many[order]
    first = np.concatenate((np.ones(min(len(a), 1), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[first], b[first], many[first]


def _stars(buckets: int):
    """(bucket, pack, data): the links of a star around one of the sets of each signature, many if it can have more than two sets.

    Sets are named by pack and place; without a bucket, data has the names of the sets of the pack. Sets that are almost equal share
    signatures in most ranges: a task tells their link once, up to LINKS, and sends links packed, by the hash of their sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, sets, held, cut_short = None, [], [], 0, False
        told: list[tuple] = []

        def links(whole: bool) -> None:
            nonlocal keys, sets, held, cut_short, told
            cut_short |= not whole
            key, own = np.concatenate(keys), np.concatenate(sets)
            order = np.argsort(key, kind="stable")  # the first of a signature stays the first
            key, own = key[order], own[order]
            lead = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.cumsum(lead) - 1
            leader, more = own[lead][group], (np.bincount(group) > 2)[group] | cut_short
            keys, sets, held = [key[lead]], [own[lead]], int(lead.sum())
            told.append(distinct_links(leader[~lead], own[~lead], more[~lead]))
            if len(told) > 1 and sum(len(x[0]) for x in told[1:]) >= max(LINKS // 4, len(told[0][0])):
                told = [distinct_links(*(np.concatenate(c) for c in zip(*told)))]

        def out() -> pa.RecordBatch:
            nonlocal told
            a, b, many = distinct_links(*(np.concatenate(c) for c in zip(*told)))
            told = []
            at = bucket_of(a, b, buckets)
            order = np.argsort(at, kind="stable")
            a, b, many, at = a[order], b[order], many[order], at[order]
            starts = np.flatnonzero(np.concatenate((np.ones(min(len(at), 1), bool), at[1:] != at[:-1])))
            data = [pack_links(a[i:j], b[i:j], many[i:j]) for i, j in zip(starts, np.append(starts[1:], len(at)))]
            return pa.RecordBatch.from_arrays([pa.array(at[starts], pa.int32()), pa.nulls(len(data), pa.int64()), pa.array(data, pa.binary())], ["bucket", "pack", "data"])

        for batch in batches:
            at, pack = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(len(at)):
                if at[i] != current:
                    if held:
                        links(True)
                    current, keys, sets, held, cut_short = at[i], [], [], 0, False
                    if told and len(told[0][0]) >= LINKS:
                        yield out()
                data, places = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                if data is None:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.array([pack[i]], pa.int64()), pa.array([places], pa.binary())], ["bucket", "pack", "data"])
                    continue
                own = np.frombuffer(places, "<u2").astype(np.int64)
                keys.append(unpacked(data, len(own)))
                sets.append(own | np.int64(pack[i] << 16))
                held += len(own)
                if held > 4 * RANGE:
                    links(False)
        if held:
            links(True)
        if told:
            yield out()

    return run


def bucket_of(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = mix(mix(a.view(U64)) ^ b.view(U64))
    return ((key >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def pack_links(a: np.ndarray, b: np.ndarray, many: np.ndarray) -> bytes:
    return a.astype("<i8").tobytes() + b.astype("<i8").tobytes() + many.astype(np.uint8).tobytes()


def unpack_links(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 17
    return np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n), np.frombuffer(data, np.uint8, n, 16 * n).astype(bool)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, many): each link of a bucket once; buckets come one after the other."""
    current, got, waiting = None, [], 0

    def out() -> Iterator[pa.RecordBatch]:
        a, b, many = distinct_links(*(np.concatenate(c) for c in zip(*got)))
        for i in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in (a, b, many)], ["a", "b", "many"])

    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if bucket != current:
                if got:
                    yield from out()
                current, got, waiting = bucket, [], 0
            got.append(unpack_links(data.as_py()))
            waiting += len(got[-1][0])
            if len(got) > 1 and waiting >= max(LINKS, len(got[0][0])):
                got, waiting = [distinct_links(*(np.concatenate(c) for c in zip(*got)))], 0
    if got:
        yield from out()


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, high, low) of the sets of packs."""
    for batch in batches:
        for pack, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            names = np.frombuffer(data, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array((pack << 16) + np.arange(len(names))), pa.array(names[:, 0]), pa.array(names[:, 1])], ["at", "high", "low"])


def candidates(docs: DataFrame, names: DataFrame, words: int, percent: int, ranges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b, many): distinct links of the stars of all signatures between sets as they were packed; (at, id, n_shingles, counts) of
    these; and a table that both are made from."""
    buckets = min(ranges, partitions(docs)) if ranges <= 8 * partitions(docs) else ranges  # so many that a bucket's links fit a task
    found = cut(sent(docs, words, percent, ranges).repartition("range").sortWithinPartitions("range").mapInArrow(tidy(_stars(buckets)), "bucket int, pack long, data binary"))
    release(docs)
    where = found.filter("bucket is null").select("pack", "data").mapInArrow(tidy(_named), "at long, high long, low long")
    where = cut(where.join(names.select("id", "high", "low", "n_shingles", "counts"), ["high", "low"]).select("at", "id", "n_shingles", "counts"))
    told = found.filter("bucket is not null").select("bucket", "data").repartition("bucket").sortWithinPartitions("bucket")
    return told.mapInArrow(tidy(_met), "a long, b long, many boolean"), where, found


class Forest:
    """Which links connect what is not connected yet; it holds a bounded number of nodes."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def add(self, a: int, b: int) -> bool:
        if len(self.up) > 1_000_000:
            self.up = {}
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def possible(links: DataFrame, where: DataFrame, percent: int) -> DataFrame:
    """The links by id (a, b, many), with ok, whether the counts of both sets leave it possible that they are similar, and tree,
    whether it is one of the few that connect as much as a task's links that are ok do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            n, m = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            x, y = batch.column(4).to_pylist(), batch.column(6).to_pylist()
            ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            for i in np.flatnonzero(ok):
                cells = min(len(x[i]), len(y[i]))
                ok[i] = np.abs(folded(x[i], cells) - folded(y[i], cells)).sum() * (100 + percent) <= (n[i] + m[i]) * (100 - percent)
            tree_ = [good and forest.add(a, b) for a, b, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ok.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ok), pa.array(tree_, pa.bool_())], ["a", "b", "many", "ok", "tree"])

    for end in ("a", "b"):
        links = links.join(where.select(F.col("at").alias(end), F.col("id").alias(f"{end}_id"), F.col("n_shingles").alias(f"{end}_n"), F.col("counts").alias(f"{end}_counts")), end)
    links = links.filter("a_id <> b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "many", "a_n", "a_counts", "b_n", "b_counts")
    return links.mapInArrow(tidy(run), "a long, b long, many boolean, ok boolean, tree boolean")


def within(tried: DataFrame, parts: DataFrame, names: DataFrame, percent: int) -> DataFrame:
    """(a, b): of stars of several sets that are not one part (id, part), the possible links between their sets, as spanning forests.

    Stars around sets of one part are taken together, and then those with the same main part, the one that has most of their
    sets. Sets outside of the main part are compared, by counts, with each other and with those in it.
    """
    stars = tried.filter("many").select("a", "b")
    for end in ("a", "b"):
        stars = stars.join(parts.select(F.col("id").alias(end), F.col("part").alias(f"{end}_part")), end, "left").withColumn(f"{end}_part", F.coalesce(f"{end}_part", end))
    stars = cut(stars)
    ends = [stars.select(F.col("a_part").alias("component"), F.col(e).alias("id"), F.col(f"{e}_part").alias("part")) for e in ("a", "b")]
    members = cut(ends[0].unionByName(ends[1]).distinct())
    main = members.groupBy("component", "part").agg(F.count("*").alias("many")).groupBy("component").agg(F.max_by("part", F.struct("many", "part")).alias("main"), F.count("*").alias("parts"))
    members = members.join(main.filter("parts > 1"), "component").select(F.col("main").alias("component"), "id", "part", "main").distinct()
    members = cut(members.join(names.select("id", "n_shingles"), "id"))
    dealt = block_tasks(members, percent).join(names.select("id", "counts", "n_shingles"), "id")
    compare = lambda x, n, y, m: maybe(x, n, y, m, percent)
    return _compared(dealt.select("task", "side", "id", "counts", "n_shingles"), compare)


def _compared(dealt: DataFrame, compare) -> DataFrame:
    """Links (a, b) of a spanning forest of the links in each task.

    dealt: task, side (0 is compared with 1; 2 with itself and with 1), id, data and n_shingles of sets.
    compare: from lists of data and numbers of shingles of two sides to a matrix of links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, {}
        for batch in batches:
            for t, side, name, data, n in zip(*(c.to_pylist() for c in batch.columns)):
                if t != task:
                    yield out(held)
                    task, held = t, {}
                held[name] = side, data, n
        yield out(held)

    def out(held: dict) -> pa.RecordBatch:
        links = []
        if len(held) > 1:
            order = sorted(held, key=lambda name: held[name][0] == 1)
            data, sizes = [held[name][1] for name in order], np.array([held[name][2] for name in order])
            n = sum(side != 1 for side, _, _ in held.values())
            found = np.zeros((len(order), len(order)), bool)
            if any(side == 2 for side, _, _ in held.values()):
                found[:n, :n] = compare(data[:n], sizes[:n], data[:n], sizes[:n])
                np.fill_diagonal(found, False)
            if 0 < n < len(order):
                found[:n, n:] = compare(data[:n], sizes[:n], data[n:], sizes[n:])
                found[n:, :n] = found[:n, n:].T
            links = [(order[i], order[j]) for i, j in tree(found)]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(tidy(run), "a long, b long")


# --- exact comparison ------------------------------------------------------


def _bitmap(members: DataFrame, bits: int) -> np.ndarray:
    """Of 2^bits classes of names, those with a member."""
    at = f"shiftrightunsigned(low, {64 - bits})"
    words = members.selectExpr(f"{at} div 64 AS word", f"shiftleft(1L, cast({at} % 64 AS int)) AS bit")
    out = np.zeros(1 << (bits - 6), np.int64)
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    out[got["word"].to_numpy(np.int64)] = got["bit"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def members_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(id, elements, n_shingles) of the members (id, high, low).

    Tasks leave out most other sets by a bit map with eight places for each member, of 2^16 to 2^26 bits (8 MB); beyond eight
    million members it leaves out fewer, and the join does the rest.
    """
    bits = min(26, max(16, members.count().bit_length() + 3))
    wanted = np.packbits(_bitmap(members, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has, seen = np.unpackbits(wanted).astype(bool), set()
        for batch in batches:
            for _, sets in document_sets(batch, words):
                rows = []
                for s in sets:
                    if len(s) and (name := set_name(s)) not in seen and has[(name[1] & (1 << 64) - 1) >> (64 - bits)]:
                        seen.add(name)
                        rows.append((*name, s.astype("<u8").tobytes(), len(s)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["high", "low", "elements", "n_shingles"])

    found = pick(docs, "text").mapInArrow(tidy(run), "high long, low long, elements binary, n_shingles long")
    found = found.join(members.select("id", "high", "low"), ["high", "low"])
    return found.dropDuplicates(["id"]).select("id", "elements", "n_shingles")


def thin(links: DataFrame) -> DataFrame:
    """Each task's links (a, b) without those between parts (x, y) that it has connected already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            keep = pa.array([forest.add(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns], ["a", "b", "x", "y"])

    return links.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long, x long, y long")


def spanning(links: DataFrame, close: DataFrame) -> DataFrame:
    """Few links (a, b, x, y) that still connect parts to the components (node, component); a large one's are thinned in several tasks."""
    size = close.groupBy("component").agg(F.ceil(F.count("*") / SPANNED).alias("tasks"))
    own = close.join(size, "component").select(F.col("node").alias("a"), "component", "tasks")
    together = links.join(own, "a").withColumn("part", F.pmod(F.xxhash64("y"), "tasks"))
    return thin(together.repartition("component", "part"))


def _blocks(count: str, elements: str) -> F.Column:
    return F.greatest(F.lit(1), F.ceil(F.col(count) / BLOCK_SETS), F.ceil(F.col(elements) / BLOCK_ELEMENTS)).cast("int")


def edge_tasks(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(task, side, id) for links (a, b): each a with a bounded number of its bs."""
    own = edges.join(names.select(F.col("id").alias("b"), "n_shingles"), "b")
    size = own.groupBy("a").agg(F.count("*").alias("many"), F.sum("n_shingles").alias("elements")).select("a", _blocks("many", "elements").alias("blocks"))
    own = own.join(size, "a").withColumn("task", F.concat_ws(":", F.col("a").cast("string"), F.pmod(F.xxhash64("b"), F.col("blocks").cast("long")).cast("string")))
    right = own.select("task", F.lit(1).alias("side"), F.col("b").alias("id"))
    return right.unionByName(own.select("task", F.lit(0).alias("side"), F.col("a").alias("id")).distinct())


def block_tasks(open_: DataFrame, percent: int) -> DataFrame:
    """(task, side, id) for sets (id, n_shingles, component, part, main): comparisons of those outside the largest part.

    A component that fits a block is one task. Others are cut into blocks by size band, by whether a set is in the component's
    largest part, and by hash. Similar sets are in one band or in neighbouring ones; two sets of the largest part are not compared.
    """
    whole = open_.groupBy("component").agg(F.count("*").alias("many"), F.sum("n_shingles").alias("elements")).select("component", (_blocks("many", "elements") == 1).alias("small"))
    own = open_.join(whole, "component")
    size_band = F.floor(F.log("n_shingles") / math.log(100 / percent) + 1e-9).cast("int")
    own = own.withColumn("band", F.when(F.col("small"), 0).otherwise(size_band)).withColumn("kind", F.when(~F.col("small") & (F.col("part") == F.col("main")), 1).otherwise(0))
    each = cut(own.groupBy("component", "band", "kind").agg(F.count("*").alias("many"), F.sum("n_shingles").alias("elements")).select("component", "band", "kind", _blocks("many", "elements").alias("blocks")))
    other = each.select("component", *(F.col(c).alias(f"_{c}") for c in ("band", "kind", "blocks")))
    met = each.join(other, "component").filter("abs(band - _band) <= 1 and (kind = 0 or _kind = 0)")
    own = own.join(met, ["component", "band", "kind"])
    own = own.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    text = lambda *c: F.concat_ws(":", *(F.col(x).cast("string") for x in c))
    mine, theirs = text("kind", "band", "block"), text("_kind", "_band", "_block")
    side = F.when(mine == theirs, 2).when(mine < theirs, 0).otherwise(1)
    return own.select(F.concat_ws("|", F.col("component").cast("string"), F.least(mine, theirs), F.greatest(mine, theirs)).alias("task"), side.alias("side"), "id")


def verified(sets: DataFrame, tasks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of a spanning forest of the similar pairs in each task."""

    def compare(x: list[bytes], n: np.ndarray, y: list[bytes], m: np.ndarray) -> np.ndarray:
        return similar([np.frombuffer(s, "<u8") for s in x], [np.frombuffer(s, "<u8") for s in y], percent)

    return _compared(tasks.join(sets, "id").select("task", "side", "id", "elements", "n_shingles"), compare)


def _linked(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of sets_of(), and (id, high, low, least, component) of their sets: the least doc_id that has a set, and what it is linked with."""
    rows = cut(sets_of(docs, words))
    shingles = rows.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = min(1 << 23, max(8 * partitions(docs), math.ceil(shingles / RANGE)))
    names = rows.filter("high is not null").groupBy("high", "low").agg(F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("least"), F.first("counts").alias("counts"))
    names = cut(names.withColumn("id", F.monotonically_increasing_id()))
    stars, packed_, found = candidates(docs, names, words, percent, ranges)
    tried = cut(possible(stars, packed_, percent))
    discard(packed_, found)
    release(docs)
    links = cut(tried.filter("tree").select("a", "b"))
    close = cut(components(links))
    where = names.select("id", "high", "low", "n_shingles")
    sets = cut(members_sets(docs, where.join(close.select(F.col("node").alias("id")), "id", "left_semi"), words))
    edges = cut(spanning(links.withColumn("x", F.col("a")).withColumn("y", F.col("b")), close))
    sure = cut(verified(sets, edge_tasks(edges, names), percent))
    part = cut(components(sure).select(F.col("node").alias("id"), F.col("component").alias("part")))
    inside = cut(within(tried, part, names, percent))
    discard(tried)
    if not inside.isEmpty():
        for end, name in (("a", "x"), ("b", "y")):
            inside = inside.join(part.select(F.col("id").alias(end), F.col("part").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))
        apart = cut(thin(inside.filter("x <> y")))
        links = cut(links.unionByName(apart.select("a", "b")))
        close = cut(components(links))
        more = cut(where.join(close.select(F.col("node").alias("id")), "id", "left_semi").join(sets.select("id"), "id", "left_anti"))
        if not more.isEmpty():
            had, sets = sets, cut(sets.unionByName(members_sets(docs, more, words)))
            discard(had)
        sure = cut(sure.unionByName(verified(sets, edge_tasks(cut(spanning(apart, close)), names), percent)))
        part = components(sure).select(F.col("node").alias("id"), F.col("component").alias("part"))
    release(docs)
    members = where.join(close.withColumnRenamed("node", "id"), "id").select("id", "n_shingles", "component")
    state = cut(members.join(part, "id", "left").withColumn("part", F.coalesce("part", "id")))
    parts = state.groupBy("component", "part").agg(F.count("*").alias("many"))
    # of two sets the only link has been compared
    apart = parts.groupBy("component").agg(F.max_by("part", F.struct("many", "part")).alias("main"), F.count("*").alias("parts"), F.sum("many").alias("all")).filter("parts > 1 and all > 2")
    open_ = cut(state.join(apart.select("component", "main"), "component").select("id", "n_shingles", "component", "part", "main"))
    if not open_.isEmpty():
        sure = cut(sure.unionByName(verified(sets, block_tasks(open_, percent), percent)))
    discard(sets)
    release(docs)
    linked = components(sure).withColumnRenamed("node", "id")
    together = names.select("id", "high", "low", "least").join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return rows, together


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: the least doc_id that links reach, its own included."""
    rows, together = _linked(docs, words, percent)
    least = together.groupBy("component").agg(F.min("least").alias("component_id"))
    found = cut(together.select("high", "low", "component").join(least, "component").drop("component"))
    out = rows.select("doc_id", "n_shingles", "high", "low").join(found, ["high", "low"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("high").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _with_sets(docs: DataFrame, words: int) -> DataFrame:
    """Adds columns _high and _low with the name of each document's set (null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in document_sets(batch, words):
                names = [set_name(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([n[i] for n in names], pa.int64()) for i in range(2))], [*part.schema.names, "_high", "_low"])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField("_high", LongType()), StructField("_low", LongType())]))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are similar to others: of each component one row stays, that with the least doc_id.

    Null doc_ids come last; of sets with the same least doc_id, or with none, the least name stays, and of rows with the
    doc_id and the set that stay, any one. Documents that are alone, and texts without words, stay as they are.
    """
    docs, back = carried(docs, "doc_id", "text")
    rows, together = _linked(docs, words, percent)
    together = cut(together)
    first = together.groupBy("component").agg(F.min(F.struct(F.col("least").isNull(), "least", "high", "low", "id")).alias("first"), F.count("*").alias("sets"))
    linked = together.join(first.filter("sets > 1"), "component")
    own = ["_high", "_low"]
    gone = cut(linked.filter("id <> first.id").select(F.col("high").alias("_high"), F.col("low").alias("_low")))
    crowded = rows.filter("high is not null").groupBy(F.col("high").alias("_high"), F.col("low").alias("_low")).agg(F.min("doc_id").alias("_least"), F.count("*").alias("rows")).filter("rows > 1")
    crowded = cut(crowded.select(*own, "_least").join(gone, own, "left_anti"))
    stay = _with_sets(docs, words).join(gone, own, "left_anti")
    copies = stay.join(crowded, own).filter(F.col("doc_id").eqNullSafe(F.col("_least"))).drop("_least").dropDuplicates(own)
    stay = stay.join(crowded, own, "left_anti").unionByName(copies)
    return back(stay)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = d.doc_id
"""
