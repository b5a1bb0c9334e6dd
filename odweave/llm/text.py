"""Text helpers of the Arrow kernels. Words are runs of bytes outside 0x20 and 0x09-0x0D; case folds A-Z only."""

from __future__ import annotations

import ctypes
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

#: Texts are worked through in pieces of about so many bytes, so a batch of very long texts stays small in memory.
SLICE_BYTES = 1 << 20

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the one of SplitMix64), element by element."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Chosen:
    """Spans that do not overlap: takes each span that leaves the ones before it alone."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        if i and self.ends[i - 1] > start:
            return False
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


def small_batches(df: DataFrame) -> None:
    """Let the session send Arrow batches of few rows and bytes, so that executors with little memory beside the heap
    hold only a few megabytes of texts at once. The setting stays: plans read it when they run."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def give_back() -> None:
    """Return this process's freed memory to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel, after which its worker holds no freed memory: a stage of two kernels leaves idle workers behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def clean(texts: pa.Array) -> pa.Array:
    """NULL texts count as empty."""
    return pc.fill_null(texts, "")


def slices(batch: pa.RecordBatch, text: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts pass ``limit`` bytes (SLICE_BYTES); every piece has one row at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    total = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    limit = limit or SLICE_BYTES
    start = 0
    while start < batch.num_rows:
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words (n + 1 of them) and all folded words, one after another."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(clean(texts)))
    length = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(parts)
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(there, dtype=np.int64)))
    offsets = ends[np.concatenate(([0], np.cumsum(length)))]
    return offsets, flat if there.all() else flat.filter(pa.array(there))


def word_hashes(flat: pa.Array) -> np.ndarray:
    """64-bit hashes of words; each distinct word of the piece is hashed once."""
    coded = flat.dictionary_encode()
    n = len(coded.dictionary)
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, n)
    return table[coded.indices.to_numpy()] if n else np.zeros(0, np.uint64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    byte = np.arange(256, dtype=np.uint64)
    space = (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))
    folded = np.where((byte >= 0x41) & (byte <= 0x5A), byte + 0x20, byte)
    return space, mix64((folded + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


_SPACE, _VALUE = _tables()
#: Base of the words' polynomial hashes, and its inverse modulo 2**64.
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(1 << bits, b, np.uint64)))) for b in (_BASE, _INVERSE))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to ``size``, or more, of the base and of its inverse."""
    return _powers(max(20, size.bit_length()))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text's words (n + 1 of them) and the 64-bit hashes of all folded words, one after another.

    A word's hash is a polynomial in its bytes, taken from running sums over the buffer, so no word becomes an object.
    """
    texts = clean(texts)
    n = len(texts)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if n == 0 or ends[-1] == ends[0]:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = ~_SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first, last = ends[:-1][ends[1:] > ends[:-1]], ends[1:][ends[1:] > ends[:-1]] - 1
    opens[first] = inside[first]
    closes[last] = inside[last]
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    out = np.zeros(len(start), np.uint64)
    done = 0
    while done < len(start):  # the words that begin in the next stretch of bytes
        low = int(start[done])
        to = max(done + 1, int(np.searchsorted(start, low + SLICE_BYTES)))
        high = int(stop[to - 1])
        up, down = powers(high - low)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[data[low:high]] * up[: high - low], dtype=np.uint64)))
        own = slice(done, to)
        out[own] = mix64((sums[stop[own] - low] - sums[start[own] - low]) * down[start[own] - low])
        done = to
    return np.searchsorted(start, ends), out


def shingles(offsets: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of each text's runs of ``k`` words, in text order, repeats included.

    A text of fewer words, but one at least, has its whole sequence as its one shingle.
    """
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out = np.concatenate(([0], np.cumsum(count)))
    acc = np.full(len(hashes), np.uint64(k), np.uint64)
    for i in range(k):  # position i of the run; short texts are set right below
        m = max(0, len(hashes) - i)
        acc[:m] = mix64(acc[:m] * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + m])
    take = np.repeat(offsets[:-1] - out[:-1], count) + np.arange(out[-1])
    found = acc[take]
    for i in np.flatnonzero((n > 0) & (n < k)):
        h = np.uint64(n[i])
        for w in hashes[offsets[i] : offsets[i + 1]]:
            h = mix64(np.array([h], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w)[0]
        found[out[i]] = h
    return out, found
