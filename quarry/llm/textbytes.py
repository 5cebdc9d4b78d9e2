"""Vectorised hashing of the words and shingles of many texts at once.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; letters A-Z
count as a-z. Word hashes are differences of one prefix polynomial over the
concatenated bytes (mod 2^64, odd base, random byte codes), mixed to 64
well-spread bits; shingle hashes fold the hashes of consecutive words. Whole
texts are processed, in chunks of about ``CHUNK`` bytes (a longer text is a
chunk of its own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U = np.uint64

_RNG = np.random.Generator(np.random.PCG64(20240229))
_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_CODES[65:91] = _CODES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = 0x9E3779B97F4A7C15
_INV = pow(BASE, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64, cached up to a chunk's length."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 2 * CHUNK), dtype=np.uint64)
        have[1:] = U(base)
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * CHUNK:
            _POW[base] = have
    return have[:n]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its row offsets; nulls are
    empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK):
    """(i, j) row ranges of about ``size`` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _spans(buf: np.ndarray, off: np.ndarray, between: np.ndarray):
    """First and last bytes of all words, and prefix hashes of ``buf``."""
    n = len(buf)
    inside = ~between[buf]
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    prefix = np.empty(n + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum(_CODES[buf] * powers(BASE, n), out=prefix[1:])
    return np.flatnonzero(start), np.flatnonzero(end), prefix


def words(buf: np.ndarray, off: np.ndarray, between: np.ndarray = _SPACE, stems: tuple[int, ...] = ()):
    """Hashes of all words, and the rows' offsets into them; ``between`` says
    which bytes separate words. With ``stems`` also (hashes, rows) of the
    first bytes of all longer words, for each length in it."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
        return (*none, np.zeros(0, np.uint64), np.zeros(0, np.int64)) if stems else none
    s, e, prefix = _spans(buf, off, between)
    inv = powers(_INV, n)[s]

    def hashed(size):
        return mix((prefix[s + size] - prefix[s]) * inv + np.asarray(size).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    whole = hashed(e - s + 1), np.searchsorted(s, off).astype(np.int64)
    if not stems:
        return whole
    row = np.repeat(np.arange(len(off) - 1), np.diff(whole[1]))
    more, rows = [], []
    for k in stems:
        long = np.flatnonzero(e - s + 1 > k)
        more.append(mix((prefix[s[long] + k] - prefix[s[long]]) * inv[long] + U(k * 0xA0761D6478BD642F % (1 << 64))))
        rows.append(row[long])
    return (*whole, np.concatenate(more), np.concatenate(rows))


def shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes per row (flat, with offsets).
    A row of 1 to k - 1 words has its whole sequence as its one shingle."""
    w, wo = words(buf, off)
    n = len(w)
    count = np.diff(wo)
    m = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    so = np.concatenate([[0], np.cumsum(m)])
    row = np.repeat(np.arange(len(count)), m)
    at = np.arange(so[-1]) - so[row] + wo[row]
    length = np.minimum(count, k)[row]
    h = np.full(so[-1], U(0x243F6A8885A308D3), dtype=np.uint64) + length.astype(np.uint64)
    for j in range(k):
        step = h * U(0x9FB21C651E98DF25) + w[np.minimum(at + j, max(n - 1, 0))] if n else h
        step = step ^ (step >> U(29))
        h = np.where(j < length, step, h)
    h = mix(h)
    for i in np.flatnonzero(m > 1):
        h[so[i]:so[i + 1]].sort()
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.searchsorted(row[keep], np.arange(len(count) + 1)).astype(np.int64)
