"""Byte-level BPE encoding and decoding on length-bucketed, padded numpy matrices.

A text is split by the vocabulary's pattern; the distinct pieces of a step are encoded together. Pieces
are bucketed by length and stand as rows of token ids in one padded matrix per bucket. In every round each
row looks up the ranks of its adjacent pairs in a hash table, merges its leftmost pair of the least rank
and closes the gap (compaction); rows without a pair to merge leave the matrix. Encoded pieces are kept
in a bounded cache of the worker. A piece longer than LONG bytes would need as many rounds as it has
bytes, so its merges are taken from a heap instead, in the same order.

Defined results: a null text is the empty text, with no tokens; repeated rows and any length are encoded
whole, each for itself; an empty table gives an empty result; other columns are ignored. Decoding joins
the bytes of the ids, so that decode(encode(text)) is the UTF-8 text; an id outside the vocabulary is an
error; null ids are none.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from bytestrata.llm.common import gather, pick, steps, tidy

#: Bytes of the longest piece that is merged in a matrix.
LONG = 256
#: Pieces that a worker keeps encoded.
CACHE_PIECES = 200_000
#: Ranges of code points that the regex library takes for letters or numbers by a later edition
#: of Unicode than the tokenizer library, which takes them for neither.
_LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x16FF4, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_LATER_CLASS = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _LATER) + "]")
_NONE = np.int32(1 << 30)
_BUCKETS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 128, LONG)


class Segments:
    """Sequences of different lengths, end to end in one array."""

    def __init__(self, parts: list, dtype) -> None:
        self.length = np.fromiter(map(len, parts), np.int64, len(parts))
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(parts), dtype) if dtype == np.uint8 else np.concatenate([np.zeros(0, dtype), *parts])

    def join(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The named sequences end to end, and where each one starts (with the end)."""
        n = self.length[which]
        return self.data[gather(self.start[which], n)], np.concatenate(([0], np.cumsum(n)))


class Vocabulary:
    """Ranks of byte strings, with a hash table of the pairs whose concatenation has a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            by_id[rank] = piece
        if len(by_id) > 1 << 20:
            raise ValueError("pairs of ranks of 2^20 and more do not fit a key")
        self.known = np.zeros(len(by_id), bool)
        self.known[list(ranks.values())] = True
        self.bytes = Segments(by_id, np.uint8)
        self.decimals = Segments([b"%d," % i for i in range(len(by_id))], np.uint8)
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        pairs = [(ranks[p[:i]] << 20 | ranks[p[i:]], r) for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        keys, values = np.array([k for k, _ in pairs], np.int64), np.array([v for _, v in pairs], np.int32)
        slots, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):  # linear probing, all keys at once: of those that meet in a free slot the last one stays
            self.probes += 1
            free = self.keys[slots[todo]] < 0
            self.keys[slots[todo[free]]] = keys[todo[free]]
            placed = self.keys[slots[todo]] == keys[todo]
            self.values[slots[todo[placed]]] = values[todo[placed]]
            todo = todo[~placed]
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's concatenation, or _NONE; ids below 0 pair with nothing."""
        shape, keys = left.shape, (left.astype(np.int64) << 20 | right).ravel()
        keys[((left < 0) | (right < 0)).ravel()] = -2
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.values[slot], _NONE)
        todo = np.flatnonzero((got != keys) & (got >= 0) & (keys >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out.reshape(shape)

    def split(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if text.isascii() or not _LATER_CLASS.search(text):
            return self.pattern.findall(text)
        # split with a private character, neither letter nor number, in the place of each later one
        return [text[m.start() : m.end()] for m in self.pattern.finditer(_LATER_CLASS.sub("\ue000", text))]

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = np.array([r], np.int32)
            elif len(p) > LONG:
                out[i] = self._heap(p)
            else:
                buckets.setdefault(next(b for b in _BUCKETS if b >= len(p)), []).append(i)
        for width, rows in buckets.items():
            for at in range(0, len(rows), most := max(1, (1 << 19) // width)):
                self._matrix(pieces, rows[at : at + most], width, out)
        return out

    def _matrix(self, pieces: list[bytes], rows: list[int], width: int, out: list) -> None:
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
        length = np.fromiter((len(pieces[i]) for i in rows), np.int64, len(rows))
        ids = np.where(np.arange(width) < length[:, None], self.single[raw], -1).astype(np.int32)
        who = np.array(rows)
        while len(who):
            if ids.shape[1] > 1:
                ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
                at = ranks.argmin(axis=1)  # the first of equal ranks: the leftmost pair
                least = ranks[np.arange(len(who)), at]
            else:
                least = np.full(len(who), _NONE)
            done = least == _NONE
            for row, own in zip(who[done], ids[done]):
                out[row] = own[own >= 0]
            if done.all():
                return
            going = ~done
            ids, who, at, least = ids[going], who[going], at[going], least[going]
            ids[np.arange(len(who)), at] = least
            keep = np.ones(ids.shape, bool)
            keep[np.arange(len(who)), at + 1] = False
            ids = ids[keep].reshape(len(who), -1)

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = [int(self.single[b]) for b in piece]
        n, words = len(ids), [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, 2) for i in range(n - 1) if (r := self.ranks.get(words[i] + words[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, j, size = heapq.heappop(heap)
            if ids[i] < 0 or j >= n or ids[j] < 0 or after[i] != j or len(words[i]) + len(words[j]) != size:
                continue
            ids[i], ids[j], words[i] = rank, -1, words[i] + words[j]
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.ranks.get(words[a] + words[b])) is not None:
                    heapq.heappush(heap, (r, a, b, len(words[a]) + len(words[b])))
        return np.array([i for i in ids if i >= 0], np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is outside the vocabulary")
        return self.bytes.join(ids)[0].tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes texts with a bounded cache of pieces."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.cache, self.ids = vocabulary, {}, []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids start (with the end)."""
        if len(self.cache) > CACHE_PIECES:
            self.cache, self.ids = {}, []
        split = self.vocabulary.split
        pieces, counts = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            own = split(t)
            counts[k] = len(own)
            pieces += own
        fresh = [p for p in dict.fromkeys(pieces) if p not in self.cache]
        for p in fresh:
            self.cache[p] = len(self.cache)
        self.ids += self.vocabulary.encode_pieces([p.encode() for p in fresh])
        which = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
        own, which = np.unique(which, return_inverse=True)
        ids, at = Segments([self.ids[i] for i in own], np.int32).join(which)
        return ids, at[np.concatenate(([0], np.cumsum(counts)))]


_WORKER: dict[tuple, Encoder] = {}


def encoder(name: str, pattern: str) -> Encoder:
    """The worker's encoder for a rank file that the driver has shared by SparkContext.addFile()."""
    if (name, pattern) not in _WORKER:
        _WORKER[name, pattern] = Encoder(Vocabulary(read_ranks(SparkFiles.get(name)), pattern))
    return _WORKER[name, pattern]


def _share(df: DataFrame, path: str) -> str:
    """Gives the rank file (some hundred kB, a parameter of the job) to all executors; its name there."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ids (array<int>): the tokens of column text."""
    own, name = pick(docs, *keep, "text"), _share(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name, pattern)
        for batch in batches:
            for part, _, _ in steps(batch, "text"):
                ids, at = coder.encode([t or "" for t in part.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], [*keep, "ids"])

    return own.mapInArrow(tidy(run), ", ".join(f"`{n}` {t}" for n, t in own.dtypes[:-1]) + ", ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and bytes (binary): what column ids stands for."""
    own, name = pick(encoded, *keep, "ids"), _share(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(name, pattern).vocabulary
        for batch in batches:
            texts = [vocabulary.decode(np.array([i for i in x or [] if i is not None], np.int64)) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.binary())], [*keep, "bytes"])

    return own.mapInArrow(tidy(run), ", ".join(f"`{n}` {t}" for n, t in own.dtypes[:-1]) + ", bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document the number of tokens, the digest of its ids, and the digest of what they decode to."""
    own, name = pick(docs, "doc_id", "text"), _share(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name, pattern)
        vocabulary = coder.vocabulary
        for batch in batches:
            for part, _, _ in steps(batch, "text"):
                ids, at = coder.encode([t or "" for t in part.column(1).to_pylist()])
                ends = at[1:] - at[:-1]
                rows = [ids[a:b] for a, b in zip(at, at[1:])]
                written = [vocabulary.decimals.join(x)[0][:-1] for x in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ends, pa.int64()), pa.array([hashlib.sha256(w.tobytes()).hexdigest() for w in written]), pa.array([hashlib.sha256(vocabulary.decode(x)).hexdigest() for x in rows])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return own.mapInArrow(tidy(run), f"doc_id {own.dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
