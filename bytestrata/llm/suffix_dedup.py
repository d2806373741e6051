"""Suffix-array dedup: passages that repeat across documents, by sparse suffix arrays.

Of all suffixes of a text (by words), those at minimiser positions are retained: in every run of
WINDOW word grams of GRAM words the least gram hash is selected by its content alone, and GRAM + WINDOW - 1 is the
least length of a passage, so that every passage that repeats has retained suffixes at the same places in both
texts. Retained suffixes are sorted by their first GRAM words and neighbours are compared, in every task and
then over all tasks: what is left are suffixes that agree with one of another text. Matches are then extended:
every passage of the least length around such a suffix, up to its furthest extent left and right, is
compared in the same way, and overlapping ones join to maximal spans. The result is exact: a word is in a span if
and only if it is in a passage of at least `least` words that another text has too.

Neighbours in a sorted list of suffixes only tell the longest extension to the right. Of two texts that share a passage, each can
have a neighbour that reaches further right and differs on the left, and the passage is lost when only neighbours are extended.
So all places at which a passage around a suffix can begin are compared, each by a hash of its words, and not the suffixes alone.

Equal texts are one text to the arrays; their documents repeat each other as a whole. Texts are told apart by 128 bits of hashes,
passages by 64. What tasks are told about repeated grams and passages is a Bloom filter with 8 to 16 bits for each of them, up to
2^MAP_BITS bits (32 MB); it goes beyond its size only where more are repeated, and then more is compared. An exact join decides.

Defined results: a null or empty text has no words and no spans; a text shorter than a passage has none; repeated
rows and copies repeat each other; passages that only repeat inside one text do not count; a null doc_id is
returned as it is; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bytestrata.llm.common import _BASE, _INVERSE, _POW, _IPOW, U64, _powers, cut, gather, mix, pick, steps, tidy, word_hashes

#: The least words of a passage, and of the grams that stand for suffixes.
LEAST, GRAM = 50, 25
#: The most bits of a place in the maps of repeated grams and passages (Bloom filters with three places for each hash).
MAP_BITS = 28
_PIECE = 1024


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n words in a row."""
    size = len(words)
    if size < n:
        return np.zeros(0, U64)
    power, back = (_POW, _IPOW) if size < len(_POW) else (_powers(_BASE, size), _powers(_INVERSE, size))
    with np.errstate(over="ignore"):
        c = np.zeros(size + 1, U64)
        np.cumsum(words * power[:size], out=c[1:])
        return mix((c[n:] - c[: size - n + 1]) * back[: size - n + 1] + U64(n))


def minimisers(grams: np.ndarray, first: np.ndarray, many: np.ndarray, window: int) -> np.ndarray:
    """Positions of the first least gram of every run of window grams; first and many: the grams of each row."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    rows = np.flatnonzero(many >= window)
    if not len(rows):
        return np.zeros(0, np.int64)
    starts = gather(first[rows], many[rows] - window + 1)
    out = []
    for a in range(0, len(starts), 1 << 16):
        s = starts[a : a + (1 << 16)]
        low = s[0]
        view = np.lib.stride_tricks.sliding_window_view(grams[low : s[-1] + window], window)
        out.append(s + view[s - low].argmin(1) if len(s) != len(view) else s + view.argmin(1))
    return np.unique(np.concatenate(out))


class Passages:
    """The grams and passages of the rows of a step."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, least: int, gram: int) -> None:
        words, first = word_hashes(buf, offsets)
        self.first, self.count = first[:-1], np.diff(first)
        self.words, self.least, self.gram = words, least, gram
        self.grams = window_hashes(words, gram)
        many = np.maximum(0, self.count - gram + 1)
        self.at = minimisers(self.grams, self.first, many, least - gram + 1)
        self.row = np.searchsorted(first, self.at, "right") - 1

    def around(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start in the row, and hash of every passage that holds one of the kept minimisers' grams."""
        at, row = self.at[keep], self.row[keep]
        low = np.maximum(self.first[row], at - (self.least - self.gram))
        high = np.minimum(self.first[row] + self.count[row] - self.least, at)
        start = np.unique(gather(low, np.maximum(0, high - low + 1)))
        row = np.searchsorted(self.first, start, "right") - 1
        # rows without words share their first word with the next row: the last of them holds it
        return row, start - self.first[row], window_hashes(self.words, self.least)[start]


def _map_of(repeated: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """Bloom filter of a column of hashes: the bits of a place, and words of 64 bits, gathered as pieces of _PIECE words."""
    bits = min(MAP_BITS, max(12, repeated.count().bit_length() + 3))
    mask = (1 << bits) - 1
    first, second = f"shiftrightunsigned({column}, {64 - bits})", f"(shiftrightunsigned({column}, {64 - 2 * bits}) & {mask})"
    third = f"((shiftleft({column}, 11) | shiftrightunsigned({column}, 53)) & {mask})"
    places = repeated.select(F.explode(F.expr(f"array({first}, {second}, {third})")).alias("at"))
    words = places.selectExpr("at div 64 AS word", "shiftleft(1L, cast(at % 64 AS int)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bit"))
    words = words.withColumn("piece", F.expr(f"word div {_PIECE}")).repartition("piece").sortWithinPartitions("piece")

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            word, bit, piece = (batch.column(i).to_numpy() for i in range(3))
            for k in np.unique(piece):
                here = piece == k
                held.setdefault(int(k), np.zeros(_PIECE, np.int64))[word[here] % _PIECE] = bit[here]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["piece", "words"])

    out = np.zeros(max(_PIECE, 1 << (bits - 6)), np.int64)
    got = words.mapInArrow(tidy(dense), "piece long, words binary").toArrow()
    for k, data in zip(got.column("piece").to_pylist(), got.column("words").to_pylist()):
        out[k * _PIECE : (k + 1) * _PIECE] = np.frombuffer(data, np.int64)
    return bits, out


def _in_map(filter_: tuple[int, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    bits, words = filter_
    mask = U64((1 << bits) - 1)
    found = np.ones(len(hashes), bool)
    for at in (hashes >> U64(64 - bits), hashes >> U64(64 - 2 * bits) & mask, (hashes << U64(11) | hashes >> U64(53)) & mask):
        found &= words[(at >> U64(6)).astype(np.int64)].view(U64) >> (at & U64(63)) & U64(1) == 1
    return found


def _collapsed(hashes: np.ndarray, *texts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorts suffixes by hash and compares neighbours: each hash once, with the least and the greatest of each name of its texts."""
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    out = [hashes[starts]]
    for names in texts:
        out += [f.reduceat(names[order], starts) if len(starts) else names for f in (np.minimum, np.maximum)]
    return tuple(out)


_TEXT = ("text_id", "text_id2")
_ENDS = ("low", "high", "low2", "high2")


def _repeated(texts: DataFrame, find, column: str, least: int, gram: int) -> DataFrame:
    """Hashes that two different texts have. find: from a step's Passages to the rows and hashes in question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, size = [], ([], []), 0
        for batch in batches:
            for part, buf, offsets in steps(batch, "text"):
                row, hashes = find(Passages(buf, offsets, least, gram))
                held.append(hashes)
                for i in range(2):
                    names[i].append(part.column(i).to_numpy()[row])
                size += len(hashes)
                if size > 300_000:
                    yield out(held, names)
                    held, names, size = [], ([], []), 0
        if size:
            yield out(held, names)

    def out(held: list, names: tuple[list, list]) -> pa.RecordBatch:
        h, *ends = _collapsed(np.concatenate(held), *map(np.concatenate, names))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *map(pa.array, ends)], [column, *_ENDS])

    found = texts.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in (column, *_ENDS)))
    ends = [(F.min if c.startswith("low") else F.max)(c).alias(c) for c in _ENDS]
    return found.groupBy(column).agg(*ends).filter("low <> high or low2 <> high2").select(column)


def repeated_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(text_id, text_id2, spans): for every text with words that another text repeats, the maximal spans (start, end), by words."""
    own = pick(docs, "text").filter("text is not null").select(*text_names(), "text")

    grams = _map_of(cut(_repeated(own, lambda p: (p.row, p.grams[p.at]), "gram", least, gram)), "gram")

    def extended(p: Passages) -> tuple[np.ndarray, np.ndarray]:
        row, _, hashes = p.around(_in_map(grams, p.grams[p.at]))
        return row, hashes

    passages = cut(_repeated(own, extended, "passage", least, gram))
    known = _map_of(passages, "passage")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part, buf, offsets in steps(batch, "text"):
                names = [part.column(i).to_numpy() for i in range(2)]
                p = Passages(buf, offsets, least, gram)
                row, start, hashes = p.around(_in_map(grams, p.grams[p.at]))
                fresh = np.array([n not in seen and not seen.add(n) for n in zip(*(x.tolist() for x in names))], bool)
                keep = _in_map(known, hashes) & fresh[row]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), *(pa.array(x[row[keep]]) for x in names), pa.array(start[keep], pa.int32())], ["passage", *_TEXT, "start"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for starts in batch.column(2):
                s = np.unique(starts.values.to_numpy())
                breaks = np.flatnonzero(np.diff(s) > least)
                spans.append([{"start": int(a), "end": int(b) + least} for a, b in zip(s[np.concatenate(([0], breaks + 1))], s[np.concatenate((breaks, [len(s) - 1]))])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], [*_TEXT, "spans"])

    found = own.mapInArrow(tidy(occurrences), "passage long, text_id long, text_id2 long, start int").join(passages, "passage", "left_semi")
    return found.groupBy(*_TEXT).agg(F.collect_set("start").alias("starts")).mapInArrow(tidy(joined), "text_id long, text_id2 long, spans array<struct<start:int,end:int>>")


def text_names() -> list[Column]:
    """Two hashes of column text, 128 bits together."""
    return [F.xxhash64("text").alias("text_id"), F.xxhash64(F.lit(7), "text").alias("text_id2")]


def repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """Every document with a passage that another document repeats: doc_id, n_words, n_repeated, n_spans and spans.

    spans lists start:end by words, end exclusive, comma-joined. A document with an equal copy repeats as a whole.
    """
    own = pick(docs, "doc_id", "text").filter("text is not null")
    own = cut(own.select("doc_id", *text_names(), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("int").alias("n_words")))
    copies = own.filter(F.col("n_words") >= least).groupBy(*_TEXT).agg(F.count("*").alias("copies")).filter("copies > 1")
    spans = cut(repeated_spans(docs, least, gram))
    marked = spans.join(copies, [*_TEXT], "full")
    out = own.join(marked, [*_TEXT])
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end")))
    out = out.withColumn("spans", F.when(F.col("copies").isNotNull(), whole).otherwise(F.col("spans")))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", F.col("n_words").cast("long"), length.alias("n_repeated"), F.size("spans").cast("long").alias("n_spans"), listed.alias("spans"))
