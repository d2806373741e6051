"""What the operators share: column picking, checkpoints, and word hashes in numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D, as ``[^\\x20\\x09-\\x0D]+``
finds them. UTF-8 never uses those bytes inside a longer character, so words can be found
and hashed on the bytes of a whole Arrow batch at once.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

U64 = np.uint64
#: Bytes of text that one numpy step works on; a longer text is one step of its own.
STEP_BYTES = 1 << 21
#: Rows of an Arrow batch where a table is cut.
ARROW_ROWS, _ARROW = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
_CHUNK_BITS = 18
_CHUNK = 1 << _CHUNK_BITS


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, by exact name and position: other columns may clash in letter case or be repeated."""
    at = [df.columns.index(n) for n in names]
    own = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    return own.select(*(F.col(f"_c{i}").alias(n) for i, n in zip(at, names, strict=True)))


def carried(df: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with every column but the needed ones under a name of its own, and the way back to its columns."""
    names = [c if c in needed and df.columns.index(c) == i else f"_x{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), lambda out: out.select(*names).toDF(*df.columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, for all executors; one of this machine where it is unset and Spark runs on this machine alone."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="bytestrata-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder, which lost executors leave in place.

    A table has its true size. A checkpoint keeps the estimate of its plan, and over rounds of joins estimates multiply
    until planning itself runs out of memory. Arrow batches have ARROW_ROWS rows at most meanwhile, since texts can be long and
    a batch stands in the memory of both the executor and its Python worker.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    rows = spark.conf.get(_ARROW)
    spark.conf.set(_ARROW, str(ARROW_ROWS if int(rows) <= 0 else min(int(rows), ARROW_ROWS)))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW, rows)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that cut() wrote; all that was made from them has been written."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df._folder)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def release(df: DataFrame) -> None:
    """Lets Spark remove the shuffle files of plans that are no longer held: it does so when the driver collects garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns memory that is free to the system: Python workers are kept between tasks, and theirs counts beside the executor's."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """An Arrow function that gives free memory back when its task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


# --- hashes ---------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_BASE = 0x9E3779B97F4A7C15
_POW = _powers(_BASE, _CHUNK + 1)
_INVERSE = pow(_BASE, -1, 1 << 64)
_IPOW = _powers(_INVERSE, _CHUNK + 1)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that do not cross offsets, and the first run of each row (with the end)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of buf[starts:ends] for each array of ends, by one running polynomial sum, in pieces of bounded size."""
    lo, hi = np.zeros(len(starts), U64), [np.zeros(len(starts), U64) for _ in ends]
    carry, scale = U64(0), U64(1)
    with np.errstate(over="ignore"):
        for a in range(0, len(buf), _CHUNK):
            b = min(len(buf), a + _CHUNK)
            c = np.zeros(b - a + 1, U64)
            np.cumsum(_BYTE[buf[a:b]] * _POW[: b - a], out=c[1:])
            c *= scale
            c += carry
            i, j = np.searchsorted(starts, (a, b))
            lo[i:j] = c[starts[i:j] - a]
            for end, got in zip(ends, hi):
                i, j = np.searchsorted(end, (a + 1, b + 1))
                got[i:j] = c[end[i:j] - a]
            carry, scale = c[-1], scale * _POW[b - a]
        high = np.array([pow(_INVERSE, k << _CHUNK_BITS, 1 << 64) for k in range((len(buf) >> _CHUNK_BITS) + 1)], U64)
        back = _IPOW[starts & (_CHUNK - 1)] * high[starts >> _CHUNK_BITS]
        return [mix((got - lo) * back + (end - starts).astype(U64)) for end, got in zip(ends, hi)]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is the empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def word_hashes(buf: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the first word of each row (with the end)."""
    if lower:
        buf = _LOWER[buf]
    starts, ends, first = spans(~_SEPARATOR[buf], offsets)
    return span_hashes(buf, starts, ends)[0], first


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words of a row, and the first shingle of each row (with the end).

    A row of fewer words has one shingle, the whole sequence; a row without words has none.
    """
    count = np.diff(first)
    many = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_first = np.concatenate(([0], np.cumsum(many)))
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(words) - n + 1), U64)
        for j in range(n):
            full += words[j : len(words) - n + 1 + j] * _POW[j + 1]
        full = mix(full + U64(n))
        out = np.empty(out_first[-1], U64)
        long = np.flatnonzero(count >= n)
        if len(long):
            at = gather(first[long], many[long])
            out[gather(out_first[long], many[long])] = full[at]
        for i in np.flatnonzero((count > 0) & (count < n)):
            own = words[first[i] : first[i + 1]]
            out[out_first[i]] = mix(np.array([(own * _POW[1 : len(own) + 1]).sum(dtype=U64) + U64(len(own))], U64))[0]
    return out, out_first


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the segments, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def steps(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most STEP_BYTES of text each (or one row), with bytes and offsets of the text."""
    texts = batch.column(batch.schema.get_field_index(column))
    buf, offsets = buffer_of(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1)
        yield batch.slice(at, end - at), buf[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def learning_rows(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """(text, label) of at most `most` labelled documents that may be learned from.

    These are the documents whose crc32(doc_id as text) mod 5 is not 0; of more than the bound, those with the
    least hash of doc_id. A document's label is the greatest of its rows; null labels are none. The ids are a
    bounded broadcast, so the documents do not move.
    """
    own = pick(labels, "doc_id", column).filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    own = own.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    some = own.groupBy("doc_id").agg(F.max(column).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return pick(docs, "doc_id", "text").join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).select("text", "label")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; null is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
