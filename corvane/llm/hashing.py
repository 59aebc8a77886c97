"""Vectorised word, shingle and window hashing over the byte buffers of an Arrow text column.

All of it works on whole slices of documents at once: no Python loop touches a word.
Hashes are polynomial (Rabin-Karp) sums modulo 2**64 over random byte values, finished by an
avalanche step, so two different sequences agree with a chance of about 2**-62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche step (splitmix64 finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, _inverse(base)
        self.up = self.down = np.ones(0, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            for name, b in (("up", self.base), ("down", self.inv)):
                p = np.full(size, b, _U)
                p[0] = 1
                np.multiply.accumulate(p, out=p)
                setattr(self, name, p)
        return self.up[:n], self.down[:n]


_BYTE_POWERS = _Powers(0x9E3779B97F4A7C13 | 3)
_WORD_POWERS = _Powers(0xD1B54A32D192ED03)
_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_PUNCT = _SPACE.copy()  # everything in ASCII but letters and digits
_PUNCT[:128] |= ~np.array([chr(c).isalnum() for c in range(128)])


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null counts as empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    bufs = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents [a, b) that hold about `limit` bytes; one document is never cut."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool, bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+`: (hash, start byte, end byte, index of the first word of each document).

    bare: ASCII punctuation separates words too.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, _U), z, z, np.zeros(len(offs), np.int64)
    word = ~(_PUNCT if bare else _SPACE)[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~word[:-1]
    inner = offs[:-1][offs[:-1] < n]
    first[inner] = True
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = first[1:] | ~word[1:]
    starts = np.flatnonzero(word & first)
    ends = np.flatnonzero(word & last) + 1
    up, down = _BYTE_POWERS.get(n + 1)
    sums = np.empty(n + 1, _U)
    sums[0] = 0
    np.cumsum((_LOWER if lower else _BYTES)[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return hashes, starts, ends, np.searchsorted(starts, offs)


def window_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of k words inside one document: (hash by start word, is the start valid)."""
    m = len(words)
    valid = np.zeros(m, bool)
    if m < k:
        return np.zeros(m, _U), valid
    up, down = _WORD_POWERS.get(m + 1)
    sums = np.empty(m + 1, _U)
    sums[0] = 0
    np.cumsum(words * up[:m], out=sums[1:])
    out = np.zeros(m, _U)
    out[: m - k + 1] = mix((sums[k:] - sums[: m - k + 1]) * down[: m - k + 1])
    valid[: m - k + 1] = True
    for back in range(1, k):  # starts whose window would cross into the next document
        at = bounds[1:] - back
        valid[at[(at >= bounds[:-1]) & (at >= 0)]] = False
    return out, valid


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document; a shorter document is one shingle of all its words."""
    words, _, _, bounds = word_hashes(data, offs, lower)
    wins, _ = window_hashes(words, bounds, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            s = np.sort(wins[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            h, up = _U(n), _WORD_POWERS.get(k)[0]
            with np.errstate(over="ignore"):
                for j in range(n):
                    h = h * _U(0xA0761D6478BD642F) + words[a + j] * up[j]
            out.append(mix(np.array([h], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out
