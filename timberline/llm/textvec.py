"""Vectorised text kernels over one byte buffer: words, hashes, distinct words.

Texts are joined into one UTF-8 buffer in bounded chunks. Word bounds come from
byte classes and word hashes from prefix sums of a polynomial modulo 2**64, so no
Python code runs for each word.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: White space of the contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters, digits and all bytes of non-ASCII characters.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: A-Z to lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _PINV)):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _powers[k] = np.cumprod(t)
    return _powers[0][:n], _powers[1][:n]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or one row."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def slices(batches: Iterator[pa.RecordBatch], limit: int = 4 * CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that few texts at a time become Python objects."""
    for b in batches:
        rows = max(1, int(b.num_rows * limit / max(b.nbytes, limit)))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def trim() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, beside their executor's heap."""
    for t in range(2):
        _powers[t] = np.ones(1, np.uint64)
    gc.collect()
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buffer, a space after each text, and where each text starts (n + 1 bounds)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return buf, bounds


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def class_spans(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of one non-zero class."""
    cut = np.flatnonzero(np.diff(kind.astype(np.int16), prepend=-1))
    ends = np.append(cut[1:], len(kind))
    keep = kind[cut] != 0
    return cut[keep], ends[keep]


class Hasher:
    """64-bit hashes of any slices of a buffer, from prefix sums."""

    def __init__(self, buf: np.ndarray):
        p, self.inv = _tables(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inv[starts])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def lanes(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, little-endian; zeros follow the buffer."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def same_slices(buf: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether slices of equal sizes at ``a`` and ``b`` hold equal bytes."""
    lane = lanes(buf)
    left = np.arange(len(a))
    k = 0
    while len(left):
        rest = np.minimum(sizes[left] - k, 8).astype(np.uint64)
        shift = (np.uint64(8) - rest) * np.uint64(8)
        if ((lane[a[left] + k] ^ lane[b[left] + k]) << shift).any():
            return False
        k += 8
        left = left[sizes[left] > k]
    return True


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of one occurrence of each distinct slice, and each slice's place among them.

    Hashes group the slices; their bytes are compared after, and on a collision
    exact keys take the hashes' place.
    """
    h = Hasher(buf)(starts, ends)
    _, first, place = np.unique(h, return_index=True, return_inverse=True)
    sizes = ends - starts
    if not ((sizes == sizes[first][place]).all() and same_slices(buf, starts, starts[first][place], sizes)):
        raw, seen = buf.tobytes(), {}
        place = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
        _, first = np.unique(place, return_index=True)
    return first, place


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i] + 0 … counts[i]-1`` for all i, one after another."""
    total = int(counts.sum())
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class Ragged:
    """Growing lists of integers by key, gathered by array of places."""

    def __init__(self, dtype: type, limit: int):
        self.dtype, self.limit = dtype, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str | bytes, int] = {}
        self.data = np.zeros(1024, self.dtype)
        self.at = np.zeros(1024, np.int64)
        self.n = self.used = 0

    def add(self, key: str | bytes, values: Sequence[int]) -> int:
        if self.used + len(values) > len(self.data):
            self.data = np.resize(self.data, max(2 * len(self.data), self.used + len(values)))
        if self.n + 2 > len(self.at):
            self.at = np.resize(self.at, 2 * len(self.at))
        self.data[self.used : self.used + len(values)] = values
        self.used += len(values)
        self.index[key] = i = self.n
        self.n += 1
        self.at[self.n] = self.used
        return i

    def add_all(self, keys: list[str | bytes], values: list[Sequence[int]]) -> np.ndarray:
        """The places of new keys, which get their values at once."""
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        total, n = int(sizes.sum()), len(keys)
        if self.used + total > len(self.data):
            self.data = np.resize(self.data, max(2 * len(self.data), self.used + total))
        if self.n + n + 1 > len(self.at):
            self.at = np.resize(self.at, max(2 * len(self.at), self.n + n + 1))
        self.data[self.used : self.used + total] = np.fromiter(chain.from_iterable(values), self.dtype, total)
        self.at[self.n + 1 : self.n + n + 1] = self.used + np.cumsum(sizes)
        self.index.update(zip(keys, range(self.n, self.n + n), strict=True))
        self.used += total
        self.n += n
        return np.arange(self.n - n, self.n)

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of all places one after another, and how many each has."""
        counts = self.at[places + 1] - self.at[places]
        return self.data[ranges(self.at[places], counts)], counts
