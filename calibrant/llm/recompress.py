"""Recompression of token sequences: rounds that name runs of equal symbols and then pairs, on flat arrays.

A name is a seeded 64-bit function of its rule (a word; a symbol and how often it follows itself; a pair of symbols), so every
executor gives equal strings equal names without holding the dictionary; names route, and texts decide (``repeats.repeated_spans``).
Each symbol also carries the word interval that determines it (``lo``, ``hi``): two
places whose words agree on that interval show the same symbol at the same offset.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .rolling import mix, word_names

_A, _B, _C = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xABC98388FB8FAC03), np.uint64(0x5851F42D4C957F2D)


@dataclass
class Level:
    name: np.ndarray  #: uint64 name of each symbol
    start: np.ndarray  #: first word
    end: np.ndarray  #: past the last word
    doc: np.ndarray  #: document of the slice
    lo: np.ndarray  #: first word that determines the symbol; -1: the document's edge is too near
    hi: np.ndarray  #: past the last such word; a huge value at the edge


NEVER = np.int64(1 << 60)


def level0(hashes: np.ndarray, doc: np.ndarray) -> Level:
    at = np.arange(len(hashes), dtype=np.int64)
    return Level(hashes, at, at + 1, doc, at, at + 1)


def lift(x: Level, seed: int = 0) -> Level:
    """One round: equal neighbours become one run, then neighbours of class 0 and class 1 one pair."""
    n = len(x.name)
    if not n:
        return x
    salt = mix(np.array([seed + 1], np.uint64) * _C)[0]
    new = np.ones(n, bool)
    new[1:] = (x.name[1:] != x.name[:-1]) | (x.doc[1:] != x.doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    size = (last - first + 1).astype(np.uint64)
    base = x.name[first]
    run = np.flatnonzero(size > 1)
    name = base.copy()
    name[run] = mix(base[run] * _A + size[run] * _B + salt)
    doc = x.doc[first]
    bit = (mix(base ^ salt) & np.uint64(1)).astype(bool)
    pair = np.zeros(len(first), bool)  # this run and the next one
    pair[:-1] = ~bit[:-1] & bit[1:] & (doc[1:] == doc[:-1])
    head = np.ones(len(first), bool)
    head[1:] = ~pair[:-1]
    at = np.flatnonzero(head)
    to = at + pair[at]
    two = pair[at]
    named = np.where(two, mix(name[at] * _A + mix(name[to] + _B) + _C + salt), name[at])
    b, e = first[at], last[to]
    inner = b > 0
    lo = np.where(inner & (x.doc[np.maximum(b - 1, 0)] == x.doc[b]), x.lo[np.maximum(b - 1, 0)], -1)
    after = np.minimum(e + 1, n - 1)
    hi = np.where((e + 1 < n) & (x.doc[after] == x.doc[e]), x.hi[after], NEVER)
    lo = np.where(inner & (x.lo[np.maximum(b - 1, 0)] < 0), -1, lo)
    return Level(named, x.start[b], x.end[e], doc[at], lo, hi)


def joined(x: Level, g: int) -> Level:
    """Names of g consecutive symbols of one document."""
    if g == 1 or len(x.name) < g:
        return x if g == 1 else Level(*(a[:0] for a in (x.name, x.start, x.end, x.doc, x.lo, x.hi)))
    m = len(x.name) - g + 1
    name = x.name[:m].copy()
    for k in range(1, g):
        name = mix(name * _B + x.name[k : k + m])
    ok = x.doc[:m] == x.doc[g - 1 :]
    lo, hi = x.lo[:m], x.hi[g - 1 :]
    return Level(name, x.start[:m], x.end[g - 1 :], x.doc[:m], np.where(ok, lo, -1), np.where(ok, hi, NEVER))


def anchors(x: Level, start: np.ndarray, width: int) -> np.ndarray:
    """For each window [p, p + width): the symbol of least mixed name among those that it determines, or -1.

    The symbols that a window determines are consecutive; the minimum comes from two overlapping power-of-two ranges.
    """
    ok = np.flatnonzero((x.lo >= 0) & (x.hi < NEVER))
    if not len(ok):
        return np.full(len(start), -1, np.int64)
    order = mix(x.name[ok] ^ _A)
    tag = np.uint64((1 << 28) - 1)
    if len(ok) > int(tag):
        raise ValueError("slice too large")
    v = (order & ~tag) | np.arange(len(ok), dtype=np.uint64)
    a = np.searchsorted(x.lo[ok], start, side="left")
    b = np.searchsorted(x.hi[ok], start + width, side="right")
    span = b - a
    out = np.full(len(start), -1, np.int64)
    table, k = v, 0
    while True:
        pick = np.flatnonzero((span >> k) == 1) if k < 62 else []
        if len(pick):
            best = np.minimum(table[a[pick]], table[b[pick] - (1 << k)])
            out[pick] = ok[(best & tag).astype(np.int64)]
        if (1 << (k + 1)) > max(1, span.max(initial=0)):
            return out
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1


def hierarchy(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, rounds: int, seed: int = 0) -> list[Level]:
    """Levels 0 .. rounds of a slice."""
    levels = [level0(word_names(data, start, end, seed), doc)]
    for k in range(rounds):
        levels.append(lift(levels[-1], (rounds + 1) * seed + k))
    return levels
