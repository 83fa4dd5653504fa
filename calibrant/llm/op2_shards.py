"""Operator 2: a uniform shuffle into shards of exact size (hypergeometric communication matrix).

Law: ``rows`` - shard sizes differ by at most one.  The target is cut into blocks of bounded size (whole slot ranges of
one shard).  How many rows each input partition sends to each block is drawn from the multivariate hypergeometric
law: counts are split down a binary tree over the partitions, each node with a seed of its own, so a task draws its own
row of the matrix from the partition sizes alone and any retry draws the same.  Rows are permuted in their partition,
dealt out by those counts, exchanged, and permuted again in their block.

All permutations with these sizes are then equally likely (up to the generator); equal texts are not kept together,
which ``rows`` could not do if a third of all rows were equal.

Edge cases: null text has size 1 and the checksum of the empty text; null and repeated ids are ordinary rows; an empty
table gives an empty one; other columns are dropped by the query and carried by the operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCK_ROWS = 50_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """An exact draw for any size: inversion of the distribution function summed outward over its whole effective range."""
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo == hi:
        return lo
    total = good + bad
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (total + 2)))
    sd = (draws * (good / total) * (bad / total) * max(1, total - draws) / max(1, total - 1)) ** 0.5
    reach = int(40 + 12 * sd)
    a, b = max(lo, mode - reach), min(hi, mode + reach)
    x = np.arange(a, b, dtype=np.float64)
    step = np.log(good - x) + np.log(draws - x) - np.log(x + 1) - np.log(bad - draws + x + 1)
    logp = np.concatenate([[0.0], np.cumsum(step)])
    p = np.cumsum(np.exp(logp - logp.max()))
    return a + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def split(rng: np.random.Generator, counts: np.ndarray, draws: int) -> np.ndarray:
    """Multivariate hypergeometric: of what is left of each block, how much falls to the first ``draws`` rows."""
    out = np.zeros_like(counts)
    left = int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        if not draws:
            break
        out[i] = hypergeometric(rng, c, left - c, draws)
        draws -= int(out[i])
        left -= c
    return out


def matrix_row(sizes: np.ndarray, blocks: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix: walk the tree of partitions from the root."""
    lo, hi, counts, total = 0, len(sizes), blocks.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(np.random.default_rng([seed, lo, hi]), counts, int(total[mid] - total[lo]))
        if part < mid:
            hi, counts = mid, left
        else:
            lo, counts = mid, counts - left
    return counts


def exact_blocks(n: int, shards: int, block_rows: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, size): shard sizes differ by one at most, blocks hold ``block_rows`` at most."""
    out = []
    for s in range(shards):
        size = n // shards + (s < n % shards)
        m = -(-size // block_rows)
        for b in range(m):
            a, e = size * b // m, size * (b + 1) // m
            out.append((s, a, e - a))
    return out


def shuffle_shards(df: DataFrame, scratch: Scratch, shards: int = 16, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All columns of ``df`` and ``shard int, slot long``.  Names ``__part, __row, __block, __pos`` are the operator's own."""
    fixed = scratch.keep(df.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "rows")
    # one number for each input partition reaches the driver, nothing by row
    per = sorted((r["__part"], r["c"], r["first"]) for r in fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("c"), F.min("__row").alias("first")).collect())
    sizes = np.array([c for _, c, _ in per], np.int64)
    index = {p: (i, first) for i, (p, _, first) in enumerate(per)}
    plan = exact_blocks(int(sizes.sum()), shards, block_rows)
    blocks = np.array([b[2] for b in plan], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            names = batch.schema.names
            part, row = (batch.column(names.index(k)).to_numpy() for k in ("__part", "__row"))
            block = np.empty(len(part), np.int32)
            for p in np.unique(part).tolist():
                i, first = index[p]
                if p not in made:
                    rng = np.random.default_rng([seed, 1 << 30, i])
                    made = {p: rng.permutation(np.repeat(np.arange(len(blocks), dtype=np.int32), matrix_row(sizes, blocks, i, seed)))}
                at = part == p
                block[at] = made[p][row[at] - first]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], names=[*names, "__block"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fixed.schema.fields)
    dealt = fixed.mapInArrow(deal, f"{types}, __block int")
    w = Window.partitionBy("__block").orderBy(F.xxhash64(F.lit(seed), "__block", "__part", "__row"), "__part", "__row")
    mixed = dealt.withColumn("__pos", F.row_number().over(w) - 1)
    shard = F.array(*[F.lit(b[0]) for b in plan]) if len(plan) < 200 else None
    if shard is None:
        table = df.sparkSession.createDataFrame([(i, s, a) for i, (s, a, _) in enumerate(plan)], "__block int, shard int, __first long")
        out = mixed.join(table, "__block")
    else:
        start = F.array(*[F.lit(b[1]).cast("long") for b in plan])
        out = mixed.withColumns({"shard": shard[F.col("__block")], "__first": start[F.col("__block")]}) if plan else mixed.withColumns({"shard": F.lit(0), "__first": F.lit(0)})
    return out.withColumn("slot", (F.col("__first") + F.col("__pos")).cast("long")).drop("__part", "__row", "__block", "__pos", "__first")


def shard_documents(docs: DataFrame, scratch: Scratch, shards: int = 16) -> DataFrame:
    """The digest query: only id, size and checksum travel."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    out = shuffle_shards(slim, scratch, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
