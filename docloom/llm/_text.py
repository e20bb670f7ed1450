"""Words of Arrow text columns as numpy arrays.

A word is a maximal run of bytes outside ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F`` after A-Z became a-z: ASCII
letters and digits, and every byte of a non-ASCII character. Words are known by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step handles at once; a longer text is a step of its own.
STEP_BYTES = 4 << 20
#: Bytes of the Arrow batches that Spark sends to Python; a longer row is a batch of its own.
BATCH_BYTES = 12 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_WORD[65:91] = True  # before lower-casing

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes whose prefix sums are taken at once; the tables of powers are as long, and a span more.
_WINDOW = 1 << 18
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * _WINDOW), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 16 * _WINDOW:
            _POWERS[base] = have
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span ``data[start:end]``; equal bytes have equal hashes anywhere. ``starts`` ascend."""
    return family_hashes(data, starts, starts[None], ends[None])[0]


def family_hashes(data: np.ndarray, base: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``span_hashes`` of several spans (rows of ``starts`` and ``ends``) at each of ascending ``base`` places, none before its base."""
    out = np.empty(starts.shape, dtype=np.uint64)
    edges = np.searchsorted(base, np.arange(0, len(data) + _WINDOW, _WINDOW))
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if lo == hi:
            continue
        at = k * _WINDOW
        part = data[at : int(ends[:, lo:hi].max())]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(part))[: len(part)], out=sums[1:])
        s, e = starts[:, lo:hi] - at, ends[:, lo:hi] - at
        out[:, lo:hi] = mix((sums[e] - sums[s]) * _powers(_BASE_INVERSE, len(part) + 1)[s] + (e - s).astype(np.uint64))
    return out


def span_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The texts of spans of UTF-8 bytes."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))).to_pylist()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null is empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def free_memory() -> None:
    """Give the system back what is not in use: Python workers are kept for later stages, which share the executor's memory with them."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def steps(batch: pa.RecordBatch, text: str | int, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``step_bytes`` bytes of text each, one row at least."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + step_bytes, side="right")) - 1
        to = min(batch.num_rows, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to
    free_memory()


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, for the executors' memory, unless the session was started with a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def with_rest(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """``id``, ``text`` and, with ``carry``, all other columns as ``rest``, so that the text is sent once; ``whole_row`` puts them together."""
    rest = _rest(docs, id_col, text_col) if carry else []
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest")] if rest else []))


def _rest(docs: DataFrame, id_col: str, text_col: str) -> list[str]:
    return [c for c in docs.columns if c not in (id_col, text_col)]


def whole_row(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """All columns of ``docs`` in their order as one struct, from ``id``, ``text`` and ``rest``."""
    own = {id_col: F.col("id"), text_col: F.col("text")}
    return F.struct(*(own.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns))


class Words:
    """The words of a column of texts: ``doc`` (row of the text), ``start``, ``end`` (byte spans in ``data``), ``hash``."""

    def __init__(self, column: pa.Array):
        raw, self.offsets = text_bytes(column)
        self.raw = raw
        self.data = LOWER[raw]
        is_word = IS_WORD[raw]
        first, last = is_word.copy(), is_word.copy()
        first[1:] &= ~is_word[:-1]
        last[:-1] &= ~is_word[1:]
        full = self.offsets[:-1][self.offsets[1:] > self.offsets[:-1]]
        first[full] = is_word[full]
        ends = self.offsets[1:][self.offsets[1:] > self.offsets[:-1]] - 1
        last[ends] = is_word[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.n_docs = len(column)
        #: words before each text
        self.bounds = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        self.hash = span_hashes(self.data, self.start, self.end)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``n`` words inside one text, and the index of the first word of each."""
        h = self.hash
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[: len(h) - n + 1] == self.doc[n - 1 :]) if n > 1 else np.arange(len(h))
        return gram_hash([h[at + k] for k in range(n)]), at


def gram_hash(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of a sequence of word hashes; order counts, and a single word is not its own hash."""
    out = np.full(len(parts[0]), len(parts), dtype=np.uint64)
    for part in parts:
        out = mix((out * np.uint64(0x9FB21C651E98DF25)) ^ part)
    return out
