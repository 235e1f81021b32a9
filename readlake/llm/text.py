"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Used inside Arrow functions. A batch is cut by bytes, never by dropping: a text longer
than the limit makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 18
# Sums modulo a power of two can be equal for different texts of some 1,000 bytes that are built
# for it (a sequence of Thue and Morse and its complement); from here on another hash is taken.
LONG_RANGE = 256
WORD_SPACE = b" \t\n\x0b\x0c\r"


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (one more entry
    than texts). A null is an empty text."""
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``limit`` bytes of text."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    block = (np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)) - 1) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers so that all bits depend on all."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


class _Rolling:
    """Running Karp-Rabin sums: the hash of any range from two prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES + 1)

            def grown(factor: int) -> np.ndarray:
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                return np.cumprod(steps, dtype=np.uint64)

            self.up, self.down = grown(self.base), grown(self.inverse)
        return self.up[:n], self.down[:n]

    def hashes(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], dtype=np.uint64, out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


@lru_cache(1)
def _state() -> tuple[_Rolling, _Rolling, np.ndarray]:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return _Rolling(0x5851F42D4C957F2D), _Rolling(0x2545F4914F6CDD1D), table


@lru_cache(8)
def _members(which: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(which)] = True
    return table


def runs(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes that are ``inside``, none of which
    crosses the border of a text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = offsets[(offsets > 0) & (offsets < len(raw))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space, tab, LF, VT, FF and CR."""
    return runs(raw, offsets, ~_members(WORD_SPACE)[raw])


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    rolling, _, table = _state()
    return rolling.hashes(table[raw], starts, ends)


def firm_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word or line, also where texts are made to have equal sums."""
    found = range_hashes(raw, starts, ends)
    long = np.flatnonzero(ends - starts >= LONG_RANGE)
    if len(long):
        data = memoryview(np.ascontiguousarray(raw))
        bounds = zip(starts[long].tolist(), ends[long].tolist())
        found[long] = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in bounds]
    return found


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each run of words, given by the hashes of the words."""
    return _state()[1].hashes(hashes, starts, ends)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each ``width`` neighbouring words, by the first; texts are not looked at."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    starts = np.arange(len(hashes) - width + 1)
    return _state()[1].hashes(hashes, starts, starts + width)


def text_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each place, the number of its text."""
    return np.searchsorted(offsets, starts, "right") - 1


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
