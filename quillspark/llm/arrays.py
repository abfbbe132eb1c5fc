"""Words, shingles and hashes of many texts at once, as numpy arrays over Arrow's own buffers.

All of this runs inside tasks, on runs of whole texts of about ``CHUNK`` bytes, so that memory does not
grow with a partition. A text longer than that is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
M64 = (1 << 64) - 1
_B, _C1, _C2 = 0x9E3779B97F4A7C15 | 1, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _table(seed: int, lower: bool) -> np.ndarray:
    t = np.random.default_rng(seed).integers(1, M64, 256, dtype=np.uint64, endpoint=True) | np.uint64(1)
    if lower:
        t[65:91] = t[97:123]
    return t


EXACT, LOWER = _table(17, False), _table(17, True)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Powers:
    """base**i and base**-i modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                    a = np.full(n, b, np.uint64)
                    a[0] = 1
                    setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


_BYTES, _WORDS, _WORDS2 = Powers(_B), Powers(0xD6E8FEB86659FD93 | 1), Powers(0xA0761D6478BD642F | 1)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _C1
        x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def spans(powers: Powers, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, from prefix sums; not mixed."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers.upto(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(values) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return (sums[end] - sums[start]) * down[start]


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column without nulls (they become empty), with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, offsets into these) for runs of whole texts."""
    column = strings(column)
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, place of each text's first word); no word crosses texts."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][np.diff(offsets) > 0]
    first[edge] |= inside[edge]
    edge = offsets[1:][np.diff(offsets) > 0] - 1
    last[edge] |= inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = EXACT) -> np.ndarray:
    return mix(spans(_BYTES, table[raw], starts, ends))


def grams(words: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hash of each n words in a row, at the first one's place."""
    k = max(0, len(words) - n + 1)
    i = np.arange(k)
    return mix(spans(_WORDS2 if second else _WORDS, words, i, i + n) + np.uint64(n))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int, table: np.ndarray = LOWER) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of all its words where these are fewer than n."""
    starts, ends, at = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends, table)
    g = grams(words, n)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            x = np.sort(g[a : b - n + 1])
            keep = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        else:
            out.append(grams(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out
