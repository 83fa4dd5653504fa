"""Operator 5: exact removal of byte strings that repeat (suffix-array deduplication by bucket-pointer refinement).

A string of ``min_bytes`` that repeats is a pair of suffixes with that common prefix.  Suffixes are put into initial buckets by
a q-gram: the q-gram of least hash among those of the suffix's first ``min_bytes`` (its anchor), so equal prefixes share a bucket
at equal offset, and buckets of one suffix are done (see ``repeats``, which exchanges runs of suffixes instead of single ones).
Within a bucket the suffix array of the texts is built by bucket-pointer refinement: suffixes are sorted by their first 8 bytes, each
one points to the end of its bucket, and every round sorts the buckets of two and more by the pointers at a later offset,
8, 16, 32, ... bytes on, reusing the pointers of the round before, until buckets share ``min_bytes``.  Nothing is hashed there.

Only suffixes whose q-gram bucket is shared are refined, because sorting every suffix of the corpus would shuffle over ten times the input.

Edge cases: null text is empty; texts shorter than ``min_bytes`` keep all; repeated rows are documents of their own, so
they remove each other; null ids are an ordinary value; a long text is read in overlapping pieces; an empty table gives an empty
table; columns other than ``doc_id``, ``text`` and those carried are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Scratch, doc_key, flat, overlapping, slices, tidy
from .repeats import digests, name_batch, repeated_spans, run_batch
from .rolling import BYTE, SPACE, grams, prefix, ranges, sliding_min

MIN_BYTES = 400
#: Texts of one bucket that a task compares at a time, in bytes.
BUCKET_BYTES = 1 << 20


def byte_runs(min_bytes: int, anchor: int | None = None, names_only: bool = False, limit: int = SLICE_BYTES):
    q = anchor or max(8, min_bytes * 16 // 25)
    tag = np.uint64((1 << 31) - 1)

    def one(kd: np.ndarray, kt: np.ndarray, data: np.ndarray, off: np.ndarray, base: int) -> pa.RecordBatch:
        g = grams(prefix(BYTE[data]), q)
        at = sliding_min((g & ~tag) | np.arange(len(g), dtype=np.uint64), min_bytes - q + 1) & tag
        size = np.diff(off)
        count = np.maximum(size - min_bytes + 1, 0)
        p = ranges(off[:-1], count)
        row = np.repeat(np.arange(len(size)), count)
        a = at[p].astype(np.int64)
        new = np.ones(len(p), bool)
        new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p))[: len(first)] - 1
        row, a, start, end = row[first], a[first], p[first], p[last]
        if names_only:
            return name_batch(kd[row], g[a])
        return run_batch(kd[row], kt[row], g[a], digests(data, start, end + min_bytes), start - off[row] + base, end - start + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", limit):
                kd, kt = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                for data, off, base in overlapping(*flat(part.column(2)), min_bytes - 1, limit):
                    if len(data) >= min_bytes:
                        yield one(kd, kt, data, off, base)

    return run


def bucket_pointers(data: np.ndarray, width: int) -> np.ndarray:
    """For every suffix of ``data`` (zeros follow) the last place in the suffix array of its bucket, the suffixes with the same ``width``-byte prefix.

    Where a prefix runs past the end, the pointer says nothing.
    """
    n = len(data)
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    gram = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(pad, 8)[:n]).view(">u8").ravel().astype(np.uint64)
    if width < 8:
        gram >>= np.uint64(8 * (8 - width))
    order = np.argsort(gram)
    ends = _ends(gram[order])
    pointer = np.empty(n, np.int64)
    pointer[order] = ends
    alone = np.empty(n, bool)
    alone[order] = np.diff(ends, prepend=-1) * np.append(ends[1:] != ends[:-1], True) == 1
    depth, active = 8, np.flatnonzero(~alone)
    while depth < width:
        step = min(depth, width - depth)  # the pointers at that offset know ``depth`` more bytes
        active = active[active < n - step]
        key = pointer[active] * n + pointer[active + step]
        order = np.argsort(key)
        key, active = key[order], active[order]
        bucket, part = _ends(key // n), _ends(key)
        # a new bucket's pointer is the old one less the members that come after it
        pointer[active] = key // n - (bucket - part)
        single = np.diff(part, prepend=-1) * np.append(part[1:] != part[:-1], True) == 1
        active = active[~single]
        depth += step
    return pointer


def _ends(ordered: np.ndarray) -> np.ndarray:
    """For each element of a sorted array the last place of an equal one."""
    last = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True)[: len(ordered)])
    return np.repeat(last, np.diff(last, prepend=-1))


def repeated_in_bucket(min_bytes: int):
    """(row, window) of windows with another place: those whose suffixes share a refined bucket (see ``repeats.in_buckets``)."""

    def solve(key: np.ndarray, weight: np.ndarray, bodies: pa.Array):
        data, off = flat(bodies.combine_chunks() if isinstance(bodies, pa.ChunkedArray) else bodies)
        n = np.diff(off) - min_bytes + 1
        row, j = np.repeat(np.arange(len(n)), n), ranges(np.zeros(len(n), np.int64), n)
        bucket = bucket_pointers(data, min_bytes)[off[row] + j]
        total = np.bincount(bucket, weights=weight[row], minlength=len(data))
        hit = (weight[row] == 1) & (total[bucket] > 1)
        return row[hit], j[hit]

    return solve


def byte_bounds(min_bytes: int):
    def bounds(data: np.ndarray, p: np.ndarray, n: np.ndarray):
        begin = ranges(p, n)
        return data, begin, begin + min_bytes

    return bounds


def covered(spans_row, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches [begin, end) of bytes (or words) under any of the windows."""
    p, n = (spans_row.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    order = np.argsort(p, kind="stable")
    begin, end = p[order], np.maximum.accumulate(np.minimum(p + n - 1 + width, size)[order])
    new = np.append(True, begin[1:] > end[:-1])
    return begin[new], end[np.append(new[1:], True)]


def whole_characters(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches grown to whole UTF-8 characters (at most three bytes either way)."""
    begin, end = begin.copy(), end.copy()
    for _ in range(3):
        begin -= (begin > 0) & ((data[np.minimum(begin, len(data) - 1)] & 0xC0) == 0x80) & (begin < len(data))
        end += (end < len(data)) & ((data[np.minimum(end, len(data) - 1)] & 0xC0) == 0x80)
    new = np.append(True, begin[1:] > end[:-1])
    return begin[new], end[np.append(new[1:], True)]


def of_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """Which stretches have at least ``least`` whole words."""
    out = np.zeros(len(begin), bool)
    for i, (b, e) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        solid = ~SPACE[data[max(0, b - 1) : e + 1]]
        if b == 0:
            solid = np.append(False, solid)
        starts = int((solid[1 : e - b + 1] & ~solid[: e - b]).sum())
        cut = starts and e < len(data) and solid[e - b] and solid[e - b + 1]
        out[i] = starts - bool(cut) >= least
    return out


def cut_bytes(min_bytes: int, characters: bool, least_words: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            text, spans_col = batch.column(names.index("text")), batch.column(names.index("spans"))
            kept, n_bytes, removed, runs = [], [], [], []
            for i in range(batch.num_rows):
                raw = text[i].as_buffer() if text[i].is_valid else b""
                data = np.frombuffer(raw, np.uint8)
                begin = end = np.zeros(0, np.int64)
                if spans_col[i].is_valid and len(data):
                    begin, end = covered(spans_col[i].values, len(data), min_bytes)
                    if least_words:
                        long = of_words(data, begin, end, least_words)
                        begin, end = begin[long], end[long]
                    if characters and len(begin):
                        begin, end = whole_characters(data, begin, end)
                view, cuts = memoryview(raw), [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(data)]
                kept.append(b"".join(view[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                removed.append(int((end - begin).sum()))
                runs.append(len(begin))
                n_bytes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i, k in enumerate(names) if k not in ("text", "spans")), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                names=[*(k for k in names if k not in ("text", "spans")), "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def suffix_dedup(docs: DataFrame, scratch: Scratch, min_bytes: int = MIN_BYTES, carry: tuple[str, ...] = (), characters: bool = False, least_words: int = 0, anchor: int | None = None, bucket_bytes: int = BUCKET_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``doc_id``, the columns of ``carry``, ``n_bytes, n_removed, n_spans, kept`` (the remaining bytes) of every row.

    ``characters``: the rest of a character that lost a byte goes, too, so that ``kept`` is valid UTF-8.
    ``least_words``: stretches of repeated bytes with fewer whole words stay.  ``anchor``: bytes of a q-gram, any up to ``min_bytes``.
    """
    keyed = doc_key(docs.select("doc_id", "text", *carry))
    texts = keyed.select("kd", "kt", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = repeated_spans(texts, lambda names_only: byte_runs(min_bytes, anchor, names_only, slice_bytes), byte_bounds(min_bytes), repeated_in_bucket(min_bytes), max(2, bucket_bytes // (2 * min_bytes)), "any", scratch)
    rest = [f"{f.name}" for f in docs.select("doc_id", *carry).schema.fields]
    out = keyed.join(found, ["kd", "kt"], "left").select(*rest, F.col("text").cast("binary").alias("text"), "spans")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema.fields)
    return out.mapInArrow(tidy(cut_bytes(min_bytes, characters, least_words)), f"{types}, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(out: DataFrame) -> DataFrame:
    """The contract's columns and ``text``, what is left of the text (characters that a cut splits show as U+FFFD)."""
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def brute_force(rows: list[tuple[int, str | None]], min_bytes: int = MIN_BYTES) -> list[tuple]:
    """The contract by definition, for small fixtures."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    count: dict[bytes, int] = {}
    for _, b in texts:
        for p in range(len(b) - min_bytes + 1):
            count[b[p : p + min_bytes]] = count.get(b[p : p + min_bytes], 0) + 1
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - min_bytes + 1):
            if count[b[p : p + min_bytes]] > 1:
                gone[p : p + min_bytes] = [True] * min_bytes
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        n = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return out
