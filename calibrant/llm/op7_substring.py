"""Operator 7: exact removal of word windows that already start in an earlier document (by recompression).

Words are level-0 symbols.  Each round names runs of equal symbols and then pairs, chosen by names only, so equal
substrings have the same interior symbols everywhere.  Every window of ``width`` words takes as anchor the symbols of least name on
the highest level that its words determine (``anchor_kinds``: the more rounds the wider the window; one round for 13 words).  Spark gathers these names from the whole
corpus and keeps the shared ones (a name only routes: sequences that share one share a bucket).  They reveal long repeats, and ``repeats`` verifies
them: runs of windows by a 128-bit digest of their words, and where texts differ the words of every window themselves.

Edge cases: null text has no words; documents with fewer words keep all; a null ``doc_id`` is
not smaller than any other and has nothing before it, so it keeps all and removes nothing; repeated rows have equal ids
and keep all they would keep alone; a long text is read in overlapping pieces; an empty table gives an empty table; columns other
than ``doc_id`` and ``text`` are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Scratch, doc_key, flat, slices
from .op5_suffix import covered
from .recompress import anchors, hierarchy, joined
from .repeats import digests, name_batch, repeated_spans, run_batch
from .rolling import SPACE, mix, ranges, words

WIDTH = 13
#: Consecutive symbols of an anchor, and by how much a round lengthens symbols on average.
GRAM, GROWTH = 3, 4 / 3
#: Different texts in one bucket that a task compares.
BUCKET_ROWS = 20_000


def anchor_kinds(width: int) -> list[tuple[int, int]]:
    """(level, consecutive symbols) of the anchors that a window tries in turn: ``GRAM`` symbols of the highest level that needs about half the
    window (its own words and its neighbours' on every lower level), then shorter and lower ones; a single word always is determined."""
    level = 0
    while GRAM * GROWTH ** (level + 1) + 2 * sum(GROWTH**k for k in range(level + 1)) <= width / 2:
        level += 1
    return [(k, g) for k in range(level, -1, -1) for g in ((GRAM, 2) if k else (2, 1)) if g <= width]


def word_pieces(batch: pa.RecordBatch, width: int, limit: int = SLICE_BYTES) -> Iterator[tuple]:
    """``(kd, kt, data, word starts, word ends, first word of each document, number of the piece's first word)``.

    A longer document is read piece by piece; a piece has the ``width - 1`` words that follow it, too.
    """
    for part in slices(batch, "text", limit):
        kd, kt = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        data, off = flat(part.column(2))
        if part.num_rows > 1 or len(data) <= limit:
            yield kd, kt, data, *words(data, off), 0
            continue
        base = at = 0
        while at < len(data):
            stop = at + limit  # a piece ends before a word
            while stop < len(data) and not (SPACE[data[stop - 1]] and not SPACE[data[stop]]):
                near = SPACE[data[stop - 1 : stop + limit]]
                step = np.flatnonzero(near[:-1] & ~near[1:])
                stop = stop + int(step[0]) if len(step) else min(len(data), stop + limit)
            stop, more, reach = min(stop, len(data)), 0, 1 << 10
            while True:
                tail = data[stop : stop + reach]
                start, end, _ = words(tail, np.array([0, len(tail)]))
                if stop + reach >= len(data) or len(start) >= width:
                    more = int(end[width - 2]) if len(end) >= width - 1 else len(tail)
                    break
                reach *= 4
            piece = data[at : stop + more]
            start, end, first = words(piece, np.array([0, len(piece)]))
            yield kd, kt, piece, start, end, first, base
            base += int(np.searchsorted(start, stop - at))
            at = stop


def joined_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words separated by one space (and one at the end), and where each begins (and the end of all)."""
    size = end - start
    at = np.append(0, np.cumsum(size + 1))
    out = np.full(int(at[-1]), 32, np.uint8)
    out[ranges(at[:-1], size)] = data[ranges(start, size)]
    return out, at


def one_spaced(data: np.ndarray) -> np.ndarray:
    """The words of one document, each followed by one space."""
    solid = ~SPACE[data]
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # the first space after a word
    out = data[keep]
    out[SPACE[out]] = 32
    return np.append(out, np.uint8(32)) if len(data) and solid[-1] else out


def word_runs(width: int, names_only: bool = False, limit: int = SLICE_BYTES):
    kinds = anchor_kinds(width)

    def one(kd, kt, data, start, end, first, base) -> pa.RecordBatch:
        per = np.diff(first)
        doc = np.repeat(np.arange(len(per)), per)
        levels = hierarchy(data, start, end, doc, kinds[0][0])
        count = np.maximum(per - width + 1, 0)
        p, row = ranges(first[:-1], count), np.repeat(np.arange(len(per)), count)
        at, name = np.full(len(p), -1, np.int64), np.zeros(len(p), np.uint64)
        for kind, (level, g) in enumerate(kinds):
            none = np.flatnonzero(at < 0)
            x = joined(levels[level], g)
            if not len(none) or not len(x.name):
                continue
            a = anchors(x, p[none], width)
            none, a = none[a >= 0], a[a >= 0]
            at[none], name[none] = x.start[a] * len(kinds) + kind, mix(x.name[a] + np.uint64(kind))
        new = np.ones(len(p), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        b = np.flatnonzero(new)
        e = np.append(b[1:], len(p))[: len(b)] - 1
        row, name, ps, pe = row[b], name[b], p[b], p[e]
        if names_only:
            return name_batch(kd[row], name)
        text, where = joined_words(data, start, end)
        return run_batch(kd[row], kt[row], name, digests(text, where[ps], where[pe + width] - 1), ps - first[row] + base, pe - ps + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in word_pieces(batch, width, limit):
                if len(piece[3]) >= width:
                    yield one(*piece)

    return run


def word_bounds(width: int):
    def bounds(data: np.ndarray, p: np.ndarray, n: np.ndarray):
        text = one_spaced(data)
        where = np.append(0, np.flatnonzero(text == 32) + 1)
        at = ranges(p, n)
        return text, where[at], where[at + width] - 1

    return bounds


def earlier_in_bucket(width: int):
    """(row, window) of windows whose words another text of smaller weight (document) of the bucket holds, compared as text."""

    def solve(key: np.ndarray, weight: np.ndarray, bodies: pa.Array):
        rows, places = [], []
        order = np.argsort(weight, kind="stable").tolist()
        seen: dict[bytes, int] = {}
        for i in order:
            body, w = bodies[i].as_py(), int(weight[i])
            cut = [0, *(np.flatnonzero(np.frombuffer(body, np.uint8) == 32) + 1).tolist(), len(body) + 1]
            for j in range(len(cut) - width):
                if seen.setdefault(body[cut[j] : cut[j + width] - 1], w) < w:
                    rows.append(i)
                    places.append(j)
        return np.array(rows, np.int64), np.array(places, np.int64)

    return solve


def cut_words(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text, spans_col = (batch.column(k) for k in range(3))
            n_words, removed, kept = [], [], []
            for i in range(batch.num_rows):
                parts = text[i].as_py().split() if text[i].is_valid else []
                n_words.append(len(parts))
                gone = 0
                if spans_col[i].is_valid and parts:
                    begin, end = covered(spans_col[i].values, len(parts), width)
                    gone, cuts = int((end - begin).sum()), [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(parts)]
                    parts = [x for a, b in zip(cuts[::2], cuts[1::2], strict=True) for x in parts[a:b]]
                removed.append(gone)
                kept.append(b" ".join(parts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def substring_dedup(docs: DataFrame, scratch: Scratch, width: int = WIDTH, bucket_rows: int = BUCKET_ROWS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the kept words, joined by one space, as UTF-8) of every row."""
    keyed = doc_key(docs.select("doc_id", "text"))
    texts = keyed.where("doc_id is not null").select("kd", "kt", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = repeated_spans(texts, lambda names_only: word_runs(width, names_only, slice_bytes), word_bounds(width), earlier_in_bucket(width), bucket_rows, "earlier", scratch)
    out = keyed.join(found, ["kd", "kt"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    return out.mapInArrow(cut_words(width), "doc_id long, n_words long, n_removed long, kept binary")


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], width: int = WIDTH) -> list[tuple]:
    """The contract by definition, for small fixtures."""
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, w in texts:
        for p in range(len(w) - width + 1 if i is not None else 0):
            k = tuple(w[p : p + width])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1 if i is not None else 0):
            if first[tuple(w[p : p + width])] < i:
                gone[p : p + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
