"""Vectorised hashing over flat byte buffers (numpy, uint64 arithmetic modulo 2**64).

Prefix sums H[i] = sum(x[j] * B**j, j < i) give the hash of all q-grams of a slice in a few array passes.  Such polynomial values
only choose and route anchors; no decision rests on their being different for different texts.  Words have names of another kind.
"""

from __future__ import annotations

import hashlib

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_pow: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 .. base**(n-1), kept for the next slice."""
    have = _pow.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        filled = 1
        while filled < size:
            m = min(filled, size - filled)
            have[filled : filled + m] = have[:m] * np.uint64(pow(int(base), filled, 2**64))
            filled += m
        if size <= 1 << 22:
            _pow[int(base)] = have
    return have[:n]


def prefix(symbols: np.ndarray) -> np.ndarray:
    """H[0..n] over uint64 symbols."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols), BASE), out=out[1:])
    return out


def grams(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all intervals of one width, by start."""
    n = len(h) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[width:] - h[:n]
    out *= powers(len(h), INVERSE)[:n]
    out += np.uint64(width * 0xA24BAED4963EE407 % 2**64)
    return mix(out)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values: block-wise prefix and suffix minima, no loop over positions."""
    n = len(v)
    if n < w:
        return v[:0]
    if w == 1:
        return v.copy()
    m = -(-n // w) * w
    pad = np.full(m, np.iinfo(v.dtype).max, v.dtype)
    pad[:n] = v
    blocks = pad.reshape(-1, w)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - w + 1], right[w - 1 : n])


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, off: np.ndarray):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a flat buffer that never cross documents: (start, end, first word of each document)."""
    n = len(data)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, off)


MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are named by a digest of their bytes.
LONG_WORD = 4096


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit names of words.  Up to seven bytes and the length are the name itself, mixed one to one; longer words go through
    a chain of mixing steps, eight bytes each (not a polynomial, whose collisions can be written down)."""
    size, key = (end - start).astype(np.int64), mix(np.array([seed + 1], np.uint64) * BASE)[0]
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(pad, 8)
    load = lambda at: np.ascontiguousarray(eight[at]).view("<u8").ravel()
    out = load(start) & MASK[np.minimum(size, 8)]
    tiny = size <= 7
    out = np.where(tiny, out | (size.astype(np.uint64) << np.uint64(56)), out)
    out = mix(out ^ key)
    left = np.flatnonzero(~tiny)
    out[left] = mix(out[left] + size[left].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    huge = left[size[left] > LONG_WORD]
    left, k = left[(size[left] > 8) & (size[left] <= LONG_WORD)], 8
    while len(left):
        x = load(start[left] + k) & MASK[np.minimum(size[left] - k, 8)]
        out[left] = mix((out[left] ^ x) * np.uint64(0x9FB21C651E98DF25) + key)
        k += 8
        left = left[size[left] > k]
    for i in huge.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little") ^ int(key)
    return out


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of start[i], start[i]+1, ..., start[i]+count[i]-1."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(start - first, count)
