"""Vectorised text primitives over Arrow columns (numpy, no per-word objects)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes (or characters) handled at once; a longer text is a group of its own.
GROUP = 1 << 20
#: Bytes hashed at once, so that the power tables stay in cache.
BLOCK = 1 << 18
M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    a = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def groups(offsets: np.ndarray, most: int = GROUP) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` bytes, or single longer rows."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _both_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``base`` and of its inverse; up to a block of them are kept."""
    if n > BLOCK:
        return _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
    if base not in _runs or len(_runs[base][0]) < n:
        size = min(BLOCK, max(4096, 2 * n))
        _runs[base] = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
    up, down = _runs[base]
    return up[:n], down[:n]


_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_UP, _DOWN = _powers(_BASE, BLOCK + 1), _powers(pow(_BASE, -1, 1 << 64), BLOCK + 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


#: Also parts words at ASCII signs.
SIGNS = _SPACE.copy()
SIGNS[[k for k in range(128) if not chr(k).isalnum()]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of consecutive rows, and each row's first word.

    Words are runs of bytes not in ``gap``, by default ``[^\\x20\\x09-\\x0D]+``.
    ``offsets`` index ``data``; words never cross rows.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    space = gap[data]
    inside = ~space
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= space[:-1] | edge[1:-1]
    last = inside
    last[:-1] &= space[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans in order; ``fold`` takes A-Z as a-z."""
    out = np.empty(len(starts), np.uint64)
    table = _FOLDED if fold else _BYTES
    i, n = 0, len(starts)
    while i < n:
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        size = int(ends[j - 1]) - base
        # A word longer than a block needs longer tables, which are not kept.
        up, down = (_UP, _DOWN) if size <= BLOCK else (_powers(_BASE, size + 1), _powers(pow(_BASE, -1, 1 << 64), size + 1))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(table[data[base : base + size]] * up[:size], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


def windows(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    base = mix(np.array([seed], np.uint64))[0] | np.uint64(1)
    if n <= 8:
        total = np.zeros(len(hashes) - n + 1, np.uint64)
        for k in range(n):
            total = total * base + hashes[k : k + len(total)]
        return mix(total)
    up, down = _both_powers(int(base), len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of texts joined by one blank, each text's start and end."""
    low = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, low), np.int64, len(low))
    ends = np.cumsum(lengths + 1) - 1
    c = np.frombuffer(" ".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < 33, np.uint32(32), c)
    return c, ends - lengths, ends


def text_groups(texts: list[str], most: int = GROUP) -> Iterator[tuple[int, int]]:
    sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    return groups(sizes, most)


def ngram_buckets(c: np.ndarray, starts: np.ndarray, ends: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at each position, and which lie within one text."""
    crossing = np.zeros(len(c), bool)
    crossing[ends[:-1]] = True  # the joining blanks
    h = np.zeros(len(c), np.uint32)
    bad = np.zeros(0, bool)
    for n in range(1, max(orders) + 1):
        m = len(c) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint32(0x01000193) + (c[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
        bad = crossing[n - 1 :] if n == 1 else bad[:m] | crossing[n - 1 :]
        if n in orders:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32((n * 0x27D4EB2F) & 0xFFFFFFFF)
            x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            yield (x >> np.uint32(32 - bits)).astype(np.int64), ~bad
