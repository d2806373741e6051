"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k least hashes of a text's shingles of five words. Sketches of parts merge into the
sketch of the whole, and two sketches estimate resemblance, containment and the number of distinct
shingles; below k shingles all of these are exact. A fingerprint is the sketch as text: hashes of 16 hex
digits in ascending order.

Defined results: a null text is the empty text, whose fingerprint is empty; a text of fewer than five
words has one shingle, all its words; two empty texts have likeness 1, an empty and another one 0. Documents
follow each other by doc_id, which must be a number or the text of one, null first, then by text; of repeated rows each one follows the last. A single
document is followed by itself. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bytestrata.llm.common import STEP_BYTES, buffer_of, partitions, pick, shingle_hashes, steps, tidy, word_hashes

WORDS = 5
#: Hashes in a sketch: the standard error of a likeness J is sqrt(J * (1 - J) / K).
K = 128


def sketches(texts: pa.Array, k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """The k least distinct shingle hashes of each text, ascending."""
    buf, offsets = buffer_of(texts)
    hashes, first = shingle_hashes(*word_hashes(buf, offsets), words)
    out = []
    for a, b in zip(first, first[1:]):
        own = hashes[a:b]
        if b - a > 8 * k:  # the least 2k hashes hold k distinct ones but for texts that repeat themselves
            few = np.unique(np.partition(own, 2 * k)[: 2 * k])
            own = few if len(few) >= k else np.unique(own)
        else:
            own = np.unique(own)
        out.append(own[:k])
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the two parts together."""
    return np.union1d(a, b)[:k]


def _meeting(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of the union that both sketches know wholly, and which of its hashes are in both."""
    both = np.sort(np.concatenate((a, b)))
    twice = np.zeros(len(both), bool)
    twice[:-1] = both[1:] == both[:-1]
    keep = np.ones(len(both), bool)
    keep[1:] = ~twice[:-1]
    union, shared = both[keep], twice[keep]
    if len(a) >= k or len(b) >= k:
        union, shared = union[:k], shared[:k]
    return union, shared


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1."""
    union, shared = _meeting(a, b, k)
    return 1.0 if not len(union) else float(shared.sum()) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has, 0 to 1."""
    if not len(a):
        return 1.0
    union, shared = _meeting(a, b, k)
    whole = float(len(union)) if len(a) < k and len(b) < k else distinct(merge(a, b, k), k)
    return min(1.0, shared.sum() / len(union) * whole / distinct(a, k))


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def sketch_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id and sketch (binary: ascending big-endian 64-bit hashes) of every whole text."""
    own = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in steps(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.astype(">u8").tobytes() for s in sketches(part.column(1), k, words)], pa.binary())], ["doc_id", "sketch"])

    return own.mapInArrow(tidy(run), f"doc_id {own.dtypes[0][1]}, sketch binary")


def merged(parts: DataFrame, by: str, k: int = K) -> DataFrame:
    """One sketch per value of a bigint or string column: the k least distinct hashes of all its sketches.

    Every task reduces its groups before the shuffle, so a large group arrives as one sketch per task.
    """
    own = pick(parts, by, "sketch")
    kind = pa.int64() if own.dtypes[0][1] == "bigint" else pa.string()

    def out(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([s.astype(">u8").tobytes() for s in held.values()], pa.binary())], [by, "sketch"])

    def reduce(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for batch in batches:
                for key, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if key not in held and len(held) >= most:
                        yield out(held)
                        held = {}
                    held[key] = merge(held.get(key, np.zeros(0, np.uint64)), sketch_bytes(s), k)
            yield out(held)

        return run

    schema = f"`{by}` {own.dtypes[0][1]}, sketch binary"
    # in the second pass equal keys stand together, so one held key is enough
    return own.mapInArrow(tidy(reduce(20_000)), schema).repartition(F.col(by)).sortWithinPartitions(by).mapInArrow(tidy(reduce(1)), schema)


def sketch_bytes(sketch: bytes | None) -> np.ndarray:
    return np.frombuffer(sketch or b"", ">u8").astype(np.uint64)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and its likeness to that and to the next document's.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next
    document. To bring neighbours together, doc_ids are dealt to ranges by quantiles, whole texts move once,
    and the first document of each range is sent to the range before it as well.
    """
    own = pick(docs, "doc_id", "text")
    ranges = 8 * max(partitions(docs), own.rdd.getNumPartitions())
    asked = [i / ranges for i in range(1, ranges)]
    quantile = F.percentile_approx("doc_id", asked, 20 * ranges).alias("q")
    bounds = np.unique(np.array(own.agg(quantile).first()["q"] or [], np.int64))

    def dealt(ids: pa.Array) -> np.ndarray:
        found = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, found) if ids.null_count else found

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int | None] = {}
        for batch in batches:
            for r, i in zip(dealt(batch.column(0)).tolist(), batch.column(0).to_pylist()):
                if r not in held or held[r] is not None and (i is None or i < held[r]):
                    held[r] = i
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.int64())], ["range", "doc_id"])

    # one row per range and task, then one per range; ranges are as many as was asked for above
    none = F.max(F.col("doc_id").isNull())
    heads = own.select(F.col("doc_id").cast("long")).mapInArrow(tidy(least), "range int, doc_id long").groupBy("range").agg(F.when(~none, F.min("doc_id")).alias("doc_id")).collect()
    heads = sorted((r["range"], r["doc_id"]) for r in heads)
    back = {heads[j][0]: (heads[j - 1][0], heads[j][1]) for j in range(len(heads))}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = dealt(batch.column(0))
            yield _with(batch, found, 0)
            first = [j for j, (r, i) in enumerate(zip(found.tolist(), batch.column(0).to_pylist())) if back[r][1] == i]
            if first:
                # the last range is followed by the first document of all
                yield _with(batch.take(pa.array(first)), np.array([back[r][0] for r in found[first].tolist()]), 1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # the last document, its sketch, its range
        for batch in batches:
            for part, _, _ in steps(batch, "text"):
                ranges, extra, ids, texts = (part.column(c).to_pylist() for c in range(4))
                own = sketches(part.column(3), k, words)
                rows = []
                for r, x, i, t, s in zip(ranges, extra, ids, texts, own):
                    t = t or ""
                    if waiting and waiting[3] == r:
                        rows.append((*waiting[:3], t, s))
                    waiting = None if x else (i, t, s, r)
                if rows:
                    yield from _likenesses(rows, k, words)

    kind = own.dtypes[0][1]
    moved = own.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(deal), "`range` int, extra int, doc_id long, text string")
    # of the documents that a range gets from the next one only the first counts: the others follow it, and are extra
    moved = moved.repartition(partitions(docs), "range").sortWithinPartitions("range", "extra", F.col("doc_id").asc_nulls_first(), "text")
    return moved.mapInArrow(tidy(compare), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumn("doc_id", F.col("doc_id").cast(kind))


def _with(batch: pa.RecordBatch, ranges: np.ndarray, extra: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(np.full(len(ranges), extra), pa.int32()), *batch.columns], ["range", "extra", "doc_id", "text"])


def _likenesses(rows: list[tuple], k: int, words: int) -> Iterator[pa.RecordBatch]:
    """rows: id, text and sketch of a document, text and sketch of the next one."""
    at = 0
    while at < len(rows):
        end, size = at, 0
        while end < len(rows) and (end == at or size < STEP_BYTES):
            size += len(rows[end][1])
            end += 1
        part, at = rows[at:end], end
        edited = [_edited(t, n) for _, t, _, n, _ in part]
        found = sketches(pa.array(edited, pa.large_string()), k, words)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in part], pa.int64()),
                pa.array([len(r[1]) for r in part], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array([text_of(r[2]) for r in part]),
                pa.array([text_of(s) for s in found]),
                pa.array([resemblance(r[2], s, k) for r, s in zip(part, found)]),
                pa.array([resemblance(r[2], r[4], k) for r in part]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
