"""Words, word hashes and shingle hashes of whole Arrow text columns, computed with numpy.

A word is ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes. Hashes depend on the bytes of the words only, never on
the process, so that equal words meet in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPAN = 1 << 19  # bytes hashed at a time


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each begins (one more entry than texts). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def groups_of(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more entry).

    ``space`` tells for each byte value whether it lies between words.
    """
    n = len(data)
    gap = np.ones(n + 2, bool)  # gap[i + 1]: byte i is white space or outside
    gap[1 : n + 1] = space[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    inside = ~gap[1 : n + 1]
    starts = np.flatnonzero(inside & (gap[:n] | cut[:n]))
    ends = np.flatnonzero(inside & (gap[2 : n + 2] | cut[1 : n + 1])) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, _SPAN + 4096)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up, cls.down


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from running sums over its bytes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + _SPAN, "right")))
        low, high = starts[at], ends[end - 1]
        up, down = _Powers.of(int(high - low) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        s, e = starts[at:end] - low, ends[at:end] - low
        out[at:end] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = end
    return mix(out)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each position on, as if all words were one text."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out = out * _STEP + words[j : len(words) - n + 1 + j]
    return mix(out)


def runs_inside(first: np.ndarray, n: int) -> np.ndarray:
    """Positions where ``n`` words follow within one text; ``first`` as returned by word_spans."""
    if first[-1] < n:
        return np.empty(0, np.int64)
    ok = np.zeros(int(first[-1]), bool)
    size = np.diff(first)
    full = size >= n
    mark = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(mark, first[:-1][full], 1)
    np.add.at(mark, first[:-1][full] + size[full] - n + 1, -1)
    ok = np.cumsum(mark[:-1]) > 0
    return np.flatnonzero(ok)
