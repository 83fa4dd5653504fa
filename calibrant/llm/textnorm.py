"""Byte-level text normalisation on flat buffers, shared by language ID and decontamination."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OTHER = np.ones(256, bool)  # ASCII bytes that are neither letters nor digits
_OTHER[48:58] = _OTHER[65:91] = _OTHER[97:123] = False
_OTHER[128:] = False
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte capitals of Latin-1 to lower case."""
    out = _LOWER[data]
    if len(out) > 1:
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[latin] += 32
    return out


def kept(data: np.ndarray, off: np.ndarray, keep: np.ndarray):
    """Buffer and offsets after dropping bytes."""
    before = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], before[off]


def bare_words(data: np.ndarray, off: np.ndarray):
    """Lower case without ASCII punctuation; white space stays."""
    low = lower(data)
    return kept(low, off, ~_OTHER[low] | _SPACE[low])


def letters(data: np.ndarray, off: np.ndarray):
    """Lower case; every stretch of other ASCII becomes one space; each document begins with one."""
    low = lower(data)
    gap = _OTHER[low] | _DIGIT[low]
    low[gap] = 32
    keep = np.ones(len(low), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    first = off[:-1][off[:-1] < len(low)]
    keep[first] = True
    return kept(low, off, keep)
