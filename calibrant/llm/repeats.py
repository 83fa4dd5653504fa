"""Which fixed-width windows of a corpus repeat, found from runs of windows instead of single windows.

Both substring operators cut each document into *runs*: consecutive windows that pick the same anchor, a
piece of text that the window's content alone determines.  Equal windows therefore lie in runs of equal anchor at equal
offset.  A run is one row ``(kd, kt, key, r1, r2, p, n)``: document key, anchor name, 128-bit digest (BLAKE2b) of the text
from the first window's start to the last one's end, first window, number of windows.  Then

1. anchors seen once are dropped (aggregate with a combiner, then an equi-join);
2. runs of equal digest are equal as a whole and settled at once;
3. where an anchor has runs with different text, one representative of each text is sent to the anchor's bucket, and the bucket
   compares the texts themselves, window by window (``solve``); its verdict goes back to all runs with that text.

Names only route: two anchors that share a name share a bucket, whose texts decide.

Skew: a key that holds over 1 / ``HEAVY`` of a join's rows is heavy; there are at most ``HEAVY`` such keys, whatever the corpus, so
their side of the join is broadcast and their rows stay where they are.  A bucket of more than ``limit`` different texts is not
gathered: its windows become rows named by the digest of their text and are counted by an aggregate with a combiner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy

RUN_SCHEMA = "kd long, kt long, key long, r1 long, r2 long, p int, n int"
NAME_SCHEMA = "kd long, key long"
PIECE_SCHEMA = "key long, r1 long, r2 long, w long, j int, d1 long, d2 long, body binary"
HITS_SCHEMA = "r1 long, r2 long, js array<int>"
#: At most this many keys hold over 1 / HEAVY of all rows; below LEAST rows no key is worth the detour.
HEAVY, LEAST = 2000, 2000
#: Bytes of bucket texts that are compared in one numpy pass; a larger bucket is a pass by itself.
TOGETHER = 1 << 18


def digests(data, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of the stretches of a buffer as two columns of signed 64-bit integers."""
    view, new = memoryview(data), hashlib.blake2b
    raw = b"".join([new(view[b:e], digest_size=16).digest() for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def run_batch(kd, kt, key, r, p, n) -> pa.RecordBatch:
    columns = [kd, kt, key.view(np.int64), r[:, 0], r[:, 1], p.astype(np.int32), n.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kd", "kt", "key", "r1", "r2", "p", "n"])


def name_batch(kd, key) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kd), pa.array(key.view(np.int64))], names=["kd", "key"])


def heavy(counts: DataFrame, key: str, count: str) -> list[int]:
    """Keys with over 1 / HEAVY of all rows: at most HEAVY numbers reach the driver."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(count) > max(LEAST, total // HEAVY)).select(key).distinct().collect()]


def split_join(left: DataFrame, right: DataFrame, on: list[str], many: list, how: str = "inner") -> DataFrame:
    """Join of keys that are never null with a ``right`` of unique keys; rows of the keys in ``many`` (first column of ``on``) are not exchanged."""
    if not many:
        return left.join(right, on, how)
    known = F.col(on[0]).isin(many)
    return left.where(~known).join(right.where(~known), on, how).unionByName(left.where(known).join(F.broadcast(right.where(known)), on, how))


def with_keys(left: DataFrame, keys: DataFrame, on: str, many: list[int]) -> DataFrame:
    """Rows of ``left`` whose key is in ``keys`` (unique), in one scan; heavy keys, which are among them, travel by row."""
    known = F.col(on).isin(many) if many else F.lit(False)
    route = F.when(known, F.xxhash64("kd", "kt", "p")).otherwise(F.col(on))
    met = left.withColumn("route", route).join(keys.select(F.col(on).alias("route"), F.lit(True).alias("met")), "route", "left")
    return met.where(known | F.col("met")).select(*left.columns)


def extract(bounds: Callable) -> Callable:
    """Texts of picked runs (``body``), or digests of their windows where ``big``.

    ``bounds(text, p, n)`` gives a buffer and, for each window of the picks, where it begins and ends in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                picks = pa.array(batch.column(1)[i].values)
                p, n, key, r1, r2, w, big = (picks.field(k).to_numpy(zero_copy_only=False) for k in range(7))
                n = n.astype(np.int64)
                data, begin, end = bounds(np.frombuffer(batch.column(0)[i].as_buffer(), np.uint8), p.astype(np.int64), n)
                first = np.cumsum(n) - n
                few, view = np.flatnonzero(~big), memoryview(data)
                if len(few):
                    lo, hi = begin[first[few]].tolist(), end[first[few] + n[few] - 1].tolist()
                    none = pa.nulls(len(few), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(key[few]), pa.array(r1[few]), pa.array(r2[few]), pa.array(w[few]), pa.nulls(len(few), pa.int32()), none, none, pa.array([bytes(view[b:e]) for b, e in zip(lo, hi, strict=True)], pa.binary())], names=PIECES)
                for k in np.flatnonzero(big).tolist():
                    own = slice(first[k], first[k] + n[k])
                    d, same = digests(data, begin[own], end[own]), lambda x: pa.array(np.full(n[k], x))  # noqa: B023
                    yield pa.RecordBatch.from_arrays([same(key[k]), same(r1[k]), same(r2[k]), same(w[k]), pa.array(np.arange(n[k], dtype=np.int32)), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.nulls(n[k], pa.binary())], names=PIECES)

    return run


PIECES = [c.split(" ")[0] for c in PIECE_SCHEMA.split(", ")]


def in_buckets(solve: Callable) -> Callable:
    """Over pieces sorted by key: ``solve(key, weight, bodies)`` on whole buckets gives (row, window) of the repeated windows.

    Several small buckets are solved together; equal pieces (of repeated rows) count once.
    """

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        r = np.stack([rows.column(k).to_numpy() for k in ("key", "r1", "r2")], axis=1)
        once = np.unique(r, axis=0, return_index=True)[1]
        rows, r = rows.take(pa.array(once)), r[once]
        row, j = solve(r[:, 0], rows.column("w").to_numpy(), rows.column("body"))
        order = np.lexsort((j, row))
        row, j = row[order], j[order]
        at = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        js = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)).astype(np.int32)), pa.array(j.astype(np.int32)))
        mine = r[row[at]] if len(row) else r[:0]
        return pa.RecordBatch.from_arrays([pa.array(mine[:, 1]), pa.array(mine[:, 2]), js], names=["r1", "r2", "js"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist()
            for i, j in zip(cut, [*cut[1:], len(key)], strict=True):
                if held and size >= TOGETHER and key[i] != last:
                    yield told(held)
                    held, size = [], 0
                part = batch.slice(i, j - i)
                held.append(part)
                off = np.frombuffer(part.column(7).buffers()[1], np.int32)[part.column(7).offset :][: j - i + 1]
                size, last = size + int(off[-1] - off[0]), key[i]
        if held:
            yield told(held)

    return run


def repeated_spans(texts: DataFrame, runs_of: Callable, bounds: Callable, solve: Callable, limit: int, mode: str, scratch: Scratch) -> DataFrame:
    """``(kd, kt, spans array<struct<p, n>>)``: windows p .. p+n-1 of a document are repeated.

    mode ``any``: the window also starts at another place; ``earlier``: it also starts in a document of smaller
    ``kd``.  texts: ``(kd, kt, text)``.  ``runs_of(names_only)``: mapInArrow function from texts to the names of runs, or to runs.  ``bounds``: see ``extract``; ``solve``: see ``in_buckets``; its weights are the number of
    runs with that text, or the least ``kd`` of them.
    """
    earlier = mode == "earlier"
    seen = texts.mapInArrow(tidy(runs_of(True)), NAME_SCHEMA).groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("kd").alias("lo"), F.max("kd").alias("hi"))
    hot = scratch.keep(seen.where("lo < hi" if earlier else "c > 1").select("key", "c"), "shared-anchors")
    runs = texts.mapInArrow(tidy(runs_of(False)), RUN_SCHEMA)
    cand = scratch.keep(with_keys(runs, hot, "key", heavy(hot, "key", "c")), "candidates")
    name = ["r1", "r2"]
    same = cand.groupBy(*name).agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("c"), F.min(F.struct("kd", "kt", "p", "n")).alias("rep"))
    same = scratch.keep(same.select(*name, "key", "c", "rep.*"), "texts-of-runs")
    open_ = "k > 1" if earlier else "k > 1 and least = 1"
    split = same.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("least")).where(open_)
    split = scratch.keep(split.select("key", "k"), "buckets")
    weight = F.col("kd") if earlier else F.col("c")
    chosen = split_join(same, split, ["key"], heavy(split, "key", "k")).select("kd", "kt", F.struct("p", "n", "key", *name, weight.alias("w"), (F.col("k") > limit).alias("big")).alias("s"))
    picks = chosen.groupBy("kd", "kt").agg(F.collect_list("s").alias("picks"))
    pieces = scratch.keep(texts.join(picks, ["kd", "kt"]).select("text", "picks").mapInArrow(tidy(extract(bounds)), PIECE_SCHEMA), "pieces")
    hits = pieces.where("body is not null").repartition("key").sortWithinPartitions("key").mapInArrow(tidy(in_buckets(solve)), HITS_SCHEMA)
    if split.where(F.col("k") > limit).limit(1).count():
        windows = pieces.where("body is null").select(*name, "j", "d1", "d2", "w").distinct()
        whole = windows.groupBy("d1", "d2").agg(F.min("w").alias("first"), F.sum("w").alias("total"), F.count(F.lit(1)).alias("rows"))
        whole = scratch.keep(whole.where("rows > 1"), "windows")
        again = split_join(windows, whole, ["d1", "d2"], heavy(whole, "d1", "rows")).where("w > first" if earlier else "w = 1 and total > 1")
        hits = hits.unionByName(again.groupBy(*name).agg(F.collect_list("j").alias("js")))
    hits = scratch.keep(hits, "repeated-windows")  # read twice below
    verdict = same.select(*name, "c", F.col("kd").alias("first")).join(hits, name, "left").where("c > 1 or js is not null")
    told = split_join(cand.select("kd", "kt", *name, "p", "n"), verdict, name, heavy(same, "r1", "c"))
    all_of_it = F.col("kd") > F.col("first") if earlier else F.col("c") > 1
    one = F.array(F.struct("p", "n"))
    some = F.transform(F.coalesce("js", F.array().cast("array<int>")), lambda j: F.struct((F.col("p") + j).alias("p"), F.lit(1).alias("n")))
    told = told.select("kd", "kt", F.explode(F.when(all_of_it, one).otherwise(some)).alias("s")).select("kd", "kt", "s.p", "s.n")
    spans = told.distinct().groupBy("kd", "kt").agg(F.collect_list(F.struct("p", "n")).alias("spans"))
    spans = scratch.keep(spans, "spans")
    scratch.drop(hot, cand, same, split, pieces, hits)
    return spans
