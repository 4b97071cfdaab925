"""Words of Arrow string batches as numpy arrays: spans, hashes and runs of words.

All functions work on whole batches of UTF-8 bytes at once. A word is a maximal run of
bytes outside 0x20 and 0x09-0x0D, which equals ``[^\\x20\\x09-\\x0D]+`` on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20  # temporaries take about 60 bytes for each byte of a piece

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LEADS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of SplitMix64)."""
    x = np.array(x, dtype=np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


@dataclass
class Batch:
    """Texts of a batch: their bytes end to end, and where each text begins."""

    data: np.ndarray
    offsets: np.ndarray  # of each text, and the end

    def __len__(self) -> int:
        return len(self.offsets) - 1


def batch_of(texts: pa.Array, lower: bool = False) -> Batch:
    """A null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    _, offs, data = texts.buffers()
    if n == 0 or data is None:
        return Batch(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64))
    offsets = np.frombuffer(offs, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return Batch(LOWER[raw] if lower else raw, offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts hold about ``limit`` bytes; a longer text is alone."""
    n = batch.num_rows
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after it
    first: np.ndarray  # number of the first word of each text, and the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def segments(b: Batch, inside: np.ndarray) -> Words:
    """Maximal runs of the marked bytes, cut where a text ends."""
    n = len(b.data)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    joint = np.zeros(n + 1, bool)
    joint[b.offsets] = True
    start = np.flatnonzero(after & (~before | joint))
    end = np.flatnonzero(before & (~after | joint))
    return Words(start, end, np.searchsorted(start, b.offsets))


def words(b: Batch) -> Words:
    return segments(b, ~SPACE[b.data])


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans are in order and do not overlap."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    length = (end - start).astype(np.int64)
    out = np.zeros(len(start), np.uint64)
    full = length > 0
    size = length[full]
    begins = np.cumsum(size) - size
    total = int(size.sum())
    with np.errstate(over="ignore"):
        if total:
            within = np.arange(total, dtype=np.int64) - np.repeat(begins, size)
            at = within + np.repeat(start[full], size)
            table = mix(np.arange(256, dtype=np.uint64) + np.uint64(seed << 16))
            power = np.ones(int(size.max()), np.uint64)
            power[1:] = constants(seed, 1)[0]
            np.multiply.accumulate(power, out=power)
            values = table[data[at]]
            values *= power[within]
            out[full] = np.add.reduceat(values, begins)
        return mix(out + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def run_hash(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes, whichever texts they lie in."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = constants(seed + 77, k)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += h[j : j + n] * c[j]
    return mix(out)


def run_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Marks the words at which a run of ``k`` words of one text begins; n - k + 1 entries."""
    total = int(first[-1])
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(total, bool)
    counts = np.diff(first)
    for j in range(1, k):  # the last k - 1 words of a text begin no run
        last = first[1:][counts >= j] - j
        ok[last] = False
    return ok[:n]


def covered(starts: np.ndarray, k: int, total: int) -> np.ndarray:
    """Marks words inside any of the runs of ``k`` words that begin at ``starts``."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + k, -1)
    return np.cumsum(step[:-1]) > 0


def per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive edges."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[edges])


def string_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of the spans as an Arrow string array."""
    size = (end - start).astype(np.int64)
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(int(offsets[-1]), dtype=np.int64) - np.repeat(offsets[:-1] - start, size)
    body = np.ascontiguousarray(data[at]) if len(at) else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(body)).cast(pa.string())
