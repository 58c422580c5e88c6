"""Vectorised words, word hashes and n-gram hashes over Arrow string columns.

All functions work on the UTF-8 bytes of a whole batch at once.  A *delimiter
table* says which byte values separate words; bytes of 0x80 and above always
belong to words, so multi-byte characters are never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text that is worked on at once, and bytes whose powers a hash uses at once.
CHUNK_BYTES = 1 << 19
HASH_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        for k, base in enumerate((_PRIME, inverse)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.multiply.accumulate(step)
    return _POWERS[0], _POWERS[1]


def _long_sum(codes: np.ndarray, buf: np.ndarray) -> np.uint64:
    """The sum that ``Words.hashes`` forms of a word's bytes, a block at a time."""
    total, mask = 0, (1 << 64) - 1
    for at in range(0, len(buf), HASH_BYTES):
        block = buf[at : at + HASH_BYTES]
        total += int((codes[block] * _powers(len(block))[0][: len(block)]).sum()) * pow(int(_PRIME), at, 1 << 64)
    return np.uint64(total & mask)


@dataclass
class Words:
    """Words of some consecutive texts of a batch."""

    buf: np.ndarray  # the texts' bytes
    text_at: np.ndarray  # per text, where its bytes start; one more at the end
    start: np.ndarray  # per word, first byte
    end: np.ndarray  # per word, byte after its last
    first: np.ndarray  # per text, index of its first word; one more at the end

    def hashes(self, table: np.ndarray | None = None, longest: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's (first ``longest``) bytes, after mapping bytes by ``table``.

        Words are taken ``HASH_BYTES`` of text at a time, a longer word by itself.
        """
        codes = _BYTES if table is None else _BYTES[table]
        out = np.empty(len(self.start), np.uint64)
        low = 0
        while low < len(out):
            base = int(self.start[low])
            high = int(np.searchsorted(self.end, base + HASH_BYTES, "right"))
            if high <= low:
                size = int(self.end[low]) - base
                out[low] = _long_sum(codes, self.buf[base : base + min(size, longest or size)])
                low += 1
                continue
            buf = self.buf[base : self.end[high - 1]]
            up, down = _powers(len(buf) + 1)
            sums = np.empty(len(buf) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(codes[buf] * up[: len(buf)], out=sums[1:])
            start, end = self.start[low:high] - base, self.end[low:high] - base
            end = end if longest is None else np.minimum(end, start + longest)
            out[low:high] = (sums[end] - sums[start]) * down[start]
            low = high
        return mix(out)

    def owner(self) -> np.ndarray:
        """Per word, the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k hashes, by where it starts; texts are not told apart."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _PRIME + hashes[j : j + n]
    return mix(out)


def split(values: pa.Array, delimiters: np.ndarray) -> Words:
    """Words of all texts of an Arrow string array; a null has none."""
    values = pc.fill_null(values.cast(pa.large_string()), "")
    n = len(values)
    at = np.frombuffer(values.buffers()[1], np.int64, n + 1, values.offset * 8) if n else np.zeros(1, np.int64)
    size = int(at[-1] - at[0])
    data = values.buffers()[2] if n else None
    buf = np.frombuffer(data, np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = np.zeros(size + 1, bool)
    inside[:size] = ~delimiters[buf]
    before = np.zeros(size + 1, bool)
    before[1:] = inside[:size]
    edge = at[(at > 0) & (at < size)]
    starts = inside & ~before
    ends = before & ~inside
    if len(edge):
        starts[edge] = inside[edge]
        ends[edge] = before[edge]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return Words(buf, at, start, end, np.searchsorted(start, at))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    total = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        base = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(low, high - low)
        low = high


#: As ``NOT_ALNUM``, for text whose A-Z are still to be lower-cased.
NOT_ALNUM_ANY_CASE = NOT_ALNUM[LOWER]


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives its free memory back: it idles beside the JVM until the next task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole
