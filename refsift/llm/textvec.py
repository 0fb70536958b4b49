"""Texts as numpy arrays: words, hashes and shingles of many texts at once, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes or code points that are worked on at once; a longer text is worked on alone.
SLICE = 1 << 19
_TABLE = 1 << 12


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed only."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)
    return mix64(steps) | U64(1)


_PLACES = seeded(_TABLE, 11)
_BYTES = seeded(256, 13)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values, and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of values [i, j) that hold about limit items, one value at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def run_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values; runs go from one start to the next, the last to the end.
    values: uint64, 0 where a place doesn't count (at the end of a run only)."""
    if not len(starts):
        return np.zeros(0, U64)
    spans = np.diff(starts, append=len(values))
    values = values[starts[0] :]
    off = np.arange(len(values), dtype=np.int64) - np.repeat(starts - starts[0], spans)
    with np.errstate(over="ignore"):
        place = _PLACES[off & (_TABLE - 1)]
        if spans.max() > _TABLE:
            place = place + (off >> 12).astype(U64) * U64(0x632BE59BD9B4E019)
        return mix64(np.add.reduceat(values * place, starts - starts[0]))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of UTF-8 texts, A-Z lower-cased."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """data: bytes of the texts one after another; offsets: n + 1 places in data, the first 0."""
        self.n = len(offsets) - 1
        blank = BLANK[data]
        solid = ~blank
        first = solid.copy()
        if len(data):
            first[1:] &= blank[:-1]
            heads = offsets[:-1][offsets[:-1] < offsets[1:]]
            first[heads] = solid[heads]
        self.starts = np.flatnonzero(first)
        self.low = LOWER[data]
        values = np.where(solid, _BYTES[self.low], U64(0))
        self.hashes = run_hashes(values, self.starts)
        #: words before[i] : before[i + 1] are text i's
        self.before = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.before)


def shingle_hashes(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, in text order, and the n + 1 offsets. A text of fewer words is one shingle."""
    weights = seeded(size, 17)
    w, counts = words.hashes, words.counts
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(out_at[-1], U64)
    with np.errstate(over="ignore"):
        if len(w) >= size:
            n = len(w) - size + 1
            rolled = np.zeros(n, U64)
            for j in range(size):
                rolled += w[j : j + n] * weights[j]
            owner = np.repeat(np.arange(words.n), counts)[:n]
            inside = np.arange(n) + size <= words.before[owner + 1]
            big = counts >= size
            place = np.repeat(big, per)
            out[place] = mix64(rolled[inside])
        for i in np.flatnonzero((counts > 0) & (counts < size)):
            part = w[words.before[i] : words.before[i + 1]]
            out[out_at[i]] = mix64(np.array([np.sum(part * weights[: len(part)]) + U64(len(part))], U64))[0]
    return out, out_at


def codepoints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after another, and the n + 1 offsets; null is empty."""
    clean = [t or "" for t in texts]
    lengths = np.fromiter(map(len, clean), np.int64, len(clean))
    data = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), "<u4")
    return data, np.concatenate([[0], np.cumsum(lengths)])
