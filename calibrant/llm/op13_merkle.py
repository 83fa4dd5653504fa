"""Operator 13: Merkle manifest of a dataset, reduced by superblocks, with a proof for each row.

Leaves are numbered within their tree by a range partition: a task numbers its own rows, and the counts of the tasks give the offsets.  Then every
``fanout ** levels`` consecutive nodes of a tree, a superblock, are one group of ``applyInPandas``, which collapses that many levels and gives each node the
siblings on its way up.  The roots of the superblocks are the nodes of the next reduction, and so on until one node is left; the proofs of a node are the lower
part from its own superblock and the upper part from its superblock's root.  No group holds more than ``fanout ** levels`` nodes, whatever share of the rows a tree has.
The roots of the trees, in order, are the leaves of one more tree.

Digests are lowercase hex.  A node is SHA-256 of its children's digests as text; a lone last node is hashed again at each level until its tree has one node left.

Edge cases: a null field is ``-``, so null and empty differ; a null tree key is a tree of its own and comes first; null ids come first, equal ids are ordered by their leaves, and
rows equal in all fields are leaves of their own (with different proofs); a tree of one leaf is its own root; an empty table gives an empty one; columns other than the
named ones are no part of the leaf; ``n_chars`` at the end of its range is tampered with in decimals, not wrapped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions

FANOUT, LEVELS = 2, 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64
#: A numbering task's rows; the rows of offsets and of upper proofs that are broadcast at most (80 and up to 700 bytes each).
TASK_ROWS, FEW_OFFSETS, FEW_PROOFS = 2_000_000, 200_000, 50_000


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)).cast("binary"), 256)


def depth(n: int, fanout: int) -> int:
    """Levels above n nodes."""
    d = 0
    while n > 1:
        n, d = -(-n // fanout), d + 1
    return d


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``at``: how many rows of the same tree came before in this partition, whose rows are sorted by tree."""
    last, seen = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        tree = batch.column(0)
        new = pc.fill_null(pc.not_equal(tree.slice(1), tree.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
        starts = [0, *(new.nonzero()[0] + 1).tolist(), n]
        at: list[pa.Array] = []
        for a, b in zip(starts, starts[1:], strict=False):
            key = tree[a].as_py()
            before = seen if key == last else 0
            at.append(pa.array(range(before, before + b - a), pa.int64()))
            last, seen = key, before + b - a
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(at)], names=[*batch.schema.names, "at"])


def numbered(nodes: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``nodes (tree, ...)``, a written table, with ``idx`` from 0 in each tree by ``order``, and ``n``, the tree's size."""
    n = nodes.count()
    ranged = nodes.repartitionByRange(partitions(nodes.sparkSession, n, TASK_ROWS), "tree", *order).sortWithinPartitions("tree", *order)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    ranged = scratch.keep(ranged.mapInArrow(_running, f"{types}, at long").withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"))
    tree = Window.partitionBy("tree")
    offsets = counts.select("tree", "part", (F.sum("c").over(tree.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(tree).alias("n"))
    offsets = scratch.keep(offsets, "offsets")
    out = ranged.join(small(offsets, offsets.count(), FEW_OFFSETS), ["tree", "part"])
    return out.withColumn("idx", F.col("at") + F.col("before")).drop("at", "part", "before")


def collapse(fanout: int, levels: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        nodes = group["node"].tolist()
        paths: list[list[str]] = [[] for _ in nodes]
        under = [[i] for i in range(len(nodes))]
        for _ in range(min(levels, depth(int(group["n"].iloc[0]), fanout))):
            up, up_under = [], []
            for i in range(0, len(nodes), fanout):
                run_of = nodes[i : i + fanout]
                for j, below in enumerate(under[i : i + fanout]):
                    others = "".join(run_of[:j] + run_of[j + 1 :])
                    for k in below:
                        paths[k].append(others)
                up.append(h("".join(run_of)))
                up_under.append([k for below in under[i : i + fanout] for k in below])
            nodes, under = up, up_under
        group["path"] = ["".join(p) for p in paths]
        group["top"] = nodes[0]
        return group

    return run


def reduced(nodes: DataFrame, scratch: Scratch, fanout: int, levels: int) -> DataFrame:
    """``nodes (tree, idx, n, node, ...)`` with ``path``, the siblings up to the tree's root, and ``root``."""
    width = fanout**levels
    block = nodes.withColumn("block", F.floor(F.col("idx") / F.lit(width)).cast("long"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in block.schema.fields)
    lower = scratch.keep(block.groupBy("tree", "block").applyInPandas(collapse(fanout, levels), f"{types}, path string, top string"), "superblocks")
    tops = lower.where(F.col("idx") == F.col("block") * width).select("tree", F.col("block").alias("idx"), F.ceil(F.col("n") / width).cast("long").alias("n"), F.col("top").alias("node"))
    if not lower.where(F.col("n") > width).limit(1).count():
        return lower.drop("block").withColumnRenamed("top", "root")
    upper = scratch.keep(reduced(tops, scratch, fanout, levels).select("tree", F.col("idx").alias("block"), F.col("path").alias("more"), "root"), "upper")
    out = lower.join(small(upper, upper.count(), FEW_PROOFS), ["tree", "block"])
    return out.withColumn("path", F.concat("path", "more")).drop("block", "top", "more")


def fold(node: str, path: str, fanout: int, *trees: tuple[int, int]) -> str:
    """The root that a node and its siblings give; ``trees``: (index, size) in each tree on the way up."""
    at = 0
    for idx, n in trees:
        while n > 1:
            first = idx // fanout * fanout
            left, others = idx - first, min(fanout, n - first) - 1
            run = path[at : at + others * HEX]
            node = h(run[: left * HEX] + node + run[left * HEX :])
            at, idx, n = at + others * HEX, idx // fanout, -(-n // fanout)
    if at != len(path):
        raise ValueError("the proof has another length than its place in the trees asks for")
    return node


def _folded(fanout: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            rows = zip(*(batch.column(names.index(c)).to_pylist() for c in ("shown", "proof", "idx", "n", "tree_idx", "trees")), strict=True)
            out = [fold(node, path, fanout, (i, n), (t, m)) for node, path, i, n, t, m in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, "folded_root"])

    return run


def manifest(docs: DataFrame, scratch: Scratch, tree: str = "lang", tampered: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, folded_root, verified`` for each row of ``docs``; rows that ``tampered`` holds for are verified with
    another ``n_chars``.  ``proof`` holds the siblings' digests one after the other."""
    more = leaf(n_chars=(F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)"))
    change = F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull() if tampered is not None else F.lit(False)
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("tree"), "doc_id", leaf().alias("node"), F.when(change, more).alias("changed"))
    leaves = scratch.keep(leaves, "leaves")
    rows = reduced(numbered(leaves, ["doc_id", "node"], scratch), scratch, fanout, levels)
    subroots = scratch.keep(rows.where("idx = 0").select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("node")), "subroots")
    tops = reduced(numbered(subroots, ["key"], scratch), scratch, fanout, levels)
    tops = scratch.keep(tops.select(F.col("key").alias("tree"), F.col("idx").alias("tree_idx"), F.col("n").alias("trees"), F.col("path").alias("more"), F.col("node").alias("subroot"), F.col("root").alias("top")), "trees")
    out = rows.drop("root").join(small(tops, tops.count(), FEW_PROOFS), "tree")
    out = out.select("doc_id", F.col("node").alias("leaf"), "subroot", F.col("top").alias("root"), F.concat("path", "more").alias("proof"), F.coalesce("changed", "node").alias("shown"), "idx", "n", "tree_idx", "trees")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    out = out.mapInArrow(_folded(fanout), f"{types}, folded_root string")
    return out.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def every_seventh(doc_id: str = "doc_id") -> Column:
    """The rows that the query tampers with."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 0


def plain(rows: list[tuple], fanout: int = 2) -> list[tuple]:
    """The query by loops over (doc_id, source, lang, n_chars, text), for tests."""
    import zlib

    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    of = lambda r: h("".join(map(show, r)))

    def build(nodes):
        paths, own = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k in range(len(paths)):
                i = own[k] // fanout * fanout
                run = nodes[i : i + fanout]
                paths[k] += [x for j, x in enumerate(run) if i + j != own[k]]
                own[k] //= fanout
            nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        return nodes[0], paths

    trees: dict = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {}
    for k in keys:
        trees[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, of(r)))
        built[k] = build([of(r) for r in trees[k]])
    root, upper = build([built[k][0] for k in keys])
    out = []
    for t, k in enumerate(keys):
        sub, paths = built[k]
        for i, r in enumerate(trees[k]):
            path = "".join(paths[i] + upper[t])
            bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = fold(of((*r[:3], r[3] + 1, r[4])) if bad else of(r), path, fanout, (i, len(trees[k])), (t, len(keys)))
            out.append((r[0], of(r), sub, root, h(path), folded, folded == root))
    return out
