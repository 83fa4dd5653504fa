"""Greedy packing of texts of any length, in linear time and inside their rows.

A text of at least ``long`` parts is walked in pieces of ``piece`` parts.  All that a piece needs to know of those before
it is the number of words in the chunk that is open at its start (0 to ``size``; a fuller chunk takes nothing more and counts as ``size``).
Python gets the numbers of words and gives the parts that begin a chunk; texts stay in their rows in the JVM, so nothing is exchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.functions.text import tokens
from calibrant.operators import chunk as ch
from calibrant.sources.tables import Workspace

LONG, PIECE = 1 << 12, 1 << 16


def following(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words before each part, and for a chunk that begins at a part, the part that begins the next one (the number of parts, if none does)."""
    before = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    after = np.searchsorted(before, before[:-1] + size, "right") - 1
    return before, np.maximum(after, np.arange(1, len(words) + 1))


def through(words: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """For 0 to ``size`` words in the open chunk: those in the chunk that is open at the end, and the number of chunks that begin."""
    before, after = following(words, size)
    n = len(words)
    left, begun = [0] * n, [0] * n
    to, total, sums = after.tolist(), int(before[-1]), before.tolist()
    for i in range(n - 1, -1, -1):
        left[i], begun[i] = (total - sums[i], 0) if to[i] == n else (left[to[i]], begun[to[i]] + 1)
    out, more = [left[0]], [begun[0]]
    for carry, first in enumerate((np.searchsorted(before, size - np.arange(1, size + 1), "right") - 1).tolist(), 1):
        out.append(carry + total if first == n else left[first])
        more.append(0 if first == n else begun[first] + 1)
    return [min(x, size) for x in out], more


def begins(words: np.ndarray, size: int, carry: int) -> tuple[list[int], int]:
    """The parts that begin a chunk, when one is open with ``carry`` words, and the words in the chunk that is open at the end."""
    before, after = following(words, size)
    n, to, found = len(words), after.tolist(), []
    at = int(np.searchsorted(before, size - carry, "right")) - 1 if carry else to[0]
    while at < n:
        found.append(at)
        at = to[at]
    left = int(before[-1] - before[found[-1]]) if found else carry + int(before[-1])
    return found, min(left, size)


def numbers(words: np.ndarray, size: int, carry: int, chunk: int) -> np.ndarray:
    """The chunk of each part, when chunk number ``chunk`` is open with ``carry`` words."""
    starts = np.zeros(len(words), np.int32)
    starts[begins(words, size, carry)[0]] = 1
    return chunk + np.cumsum(starts, dtype=np.int32)


def _starts(size: int, long: int, piece: int):
    """Of each text's numbers of words the parts that begin a chunk."""

    def run(lists: pa.Array) -> pa.Array:
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        words, ends, found, until = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes).tolist(), [], [0]
        for n, end in zip(sizes.tolist(), ends):
            own, step, carry = words[end - n : end], n if n < long else piece, 0
            if n:
                found.append(0)
            for at in range(0, n, step or 1):
                begun, carry = begins(own[at : at + step], size, carry)
                found += [at + x for x in begun]
            until.append(len(found))
        return pa.ListArray.from_arrays(pa.array(until, pa.int32()), pa.array(found, pa.int32()))

    return run


def pack(df: DataFrame, key: list[str], text: str, method: str, workspace: Workspace | None = None, size: int = ch.SIZE, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """``*key, chunk_id, chunk``, equal to ``METHODS[method]``; rows are told apart even where their keys are equal or null, a null or blank text has no chunk."""
    if method not in ch.PARTS:
        raise ValueError(f"unknown packing method {method!r}; known: {sorted(ch.PARTS)}")
    if size < 1:
        raise ValueError("size must be positive")
    parts, glue = ch.PARTS[method]
    cut = df.select(*key, parts(F.col(text)).alias("__parts")).withColumn("__words", F.transform("__parts", lambda x: F.size(tokens(x))))
    begun = cut.withColumn("__starts", F.arrow_udf(_starts(size, long, piece), "array<int>")("__words"))
    part = lambda s, j: F.slice("__parts", s + 1, F.coalesce(F.get("__starts", j + 1), F.size("__parts")) - s)
    return begun.select(*key, F.posexplode(F.transform("__starts", lambda s, j: F.array_join(part(s, j), glue))).alias("chunk_id", "chunk"))
