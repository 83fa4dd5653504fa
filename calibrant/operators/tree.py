"""Summary trees: nodes are clustered, each cluster is condensed into a node of the next level, until a sample has one root; all levels are searched.

Clusters are made for all samples in the same jobs.  ``grow`` splits a cluster in two and asks Schwarz's criterion (BIC of spherical Gaussians) whether two
describe its vectors better than one; clusters of more than ``most`` members are split in any case, so that a condensing call has at most so many texts. Clusters of
more than ``GATHERED`` members are split by Spark: a round of k-means joins every node with the two centres of its cluster only and sums the vectors of each side
with partial aggregates, so its work is linear in the nodes and a sample of any size is spread over all tasks. Smaller ones are one group of ``applyInPandas`` each,
which splits them further by the same rule.  ``assign`` takes given centres instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrant.operators.search import BROADCAST_ROWS, TILE, dense_topk, small, unit
from calibrant.sources.tables import Workspace

MOST, ITERATIONS, LEVELS = 8, 3, 40
#: Given centres that a task holds.
CENTRES = 1 << 20
#: Members of a cluster that one task takes.
GATHERED = 2048
#: Of two parts of a cluster that must be split the smaller one has two members and this share at least, else halves are cut along the line between the centres.
LEAST_SHARE, HALVED = 0.05, 100_000


def distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def mean(dim: int, v: str = "v") -> Column:
    """The mean vector of a group, entry by entry, so that it is combined before the shuffle."""
    return F.array(*[F.avg(F.col(v)[i]) for i in range(dim)])


def _nearest(shared):
    """Rows of a partition with the centre that is nearest: products find the candidates, distances decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            group, vectors = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), batch.column(2)
            cluster, found = np.full(len(batch), -1), {}
            for g, name in enumerate(coded.dictionary.to_pylist()):
                if name not in groups:
                    continue
                c, names = groups[name]
                rows, size = np.flatnonzero(group == g), (c * c).sum(axis=1)
                base = sum(len(x) for x in found.values())
                found[g] = names
                for start in range(0, len(rows), max(1, TILE // len(c))):
                    at = rows[start : start + max(1, TILE // len(c))]
                    v = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                    near = size - 2 * (v @ c.T)  # less the vector's own square
                    least = near.min(axis=1, keepdims=True)
                    row, col = np.nonzero(near <= least + (2e-9 + 1e-13 * (np.abs(least) + size.max())))
                    exact = np.zeros(len(row))
                    for x, y in zip(v[row].T, c[col].T):
                        exact += (x - y) * (x - y)
                    exact = np.floor(exact * 1e9 + 0.5)
                    order = np.lexsort((col, exact, row))
                    first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
                    cluster[at[row[first]]] = base + col[first]
            kept = np.flatnonzero(cluster >= 0)
            names = pa.concat_arrays(list(found.values())) if found else pa.array([], pa.string())
            part = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), names.take(pa.array(cluster[kept]))], names=["sample_id", "node", "cluster"])

    return run


def assign(nodes: DataFrame, centres: DataFrame) -> DataFrame:
    """nodes ``(sample_id, node, v)``, centres ``(sample_id, cluster, c)`` to ``sample_id, node, cluster`` of the nearest centre, ties to the smaller one.

    Every node meets all centres of its sample, in blocked matrix products; up to ``CENTRES`` centres go to all tasks.
    """
    spark = nodes.sparkSession
    n = centres.count()
    if n > CENTRES or not n or any(df.schema[c].dataType.simpleString() != "string" for df, c in ((nodes, "sample_id"), (nodes, "node"), (centres, "cluster"))):
        listed = centres.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("__centres"))
        near = F.array_min(F.transform("__centres", lambda x: F.struct(F.round(distance2(F.col("v"), x["c"]), 9).alias("d"), x["cluster"].alias("cluster"))))
        return nodes.join(small(listed), "sample_id").withColumn("cluster", near["cluster"]).select("sample_id", "node", "cluster")
    rows = centres.select("sample_id", "cluster", F.col("c").cast("array<double>").alias("c")).orderBy("sample_id", "cluster").toArrow().combine_chunks()
    samples, groups = rows.column("sample_id").combine_chunks().dictionary_encode(), {}
    at, c = samples.indices.fill_null(-1).to_numpy(zero_copy_only=False), rows.column("c").combine_chunks()
    for g, name in enumerate(samples.dictionary.to_pylist()):
        mine = pa.array(np.flatnonzero(at == g))
        groups[name] = (c.take(mine).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1), rows.column("cluster").combine_chunks().take(mine))
    each = nodes.select("sample_id", "node", F.col("v").cast("array<double>").alias("v"))
    return each.mapInArrow(_nearest(spark.sparkContext.broadcast(groups)), "sample_id string, node string, cluster string")


def _bic_gain(n: Column, whole: Column, parts: list[tuple[Column, Column]], dim: int) -> Column:
    """BIC of two spherical Gaussians with a common variance less that of one (Pelleg and Moore's form); the sums are of squared distances to the centres."""
    least = 1e-12

    def log_likelihood(total: Column, spread: Column, k: int, sizes: list[Column]) -> Column:
        variance = F.greatest(spread / (F.greatest(total - k, F.lit(1)) * dim), F.lit(least))
        return sum((m * F.log(m / total) for m in sizes), F.lit(0.0)) - total * dim / 2 * F.log(2 * 3.141592653589793 * variance) - (total - k) * dim / 2

    one = log_likelihood(n, whole, 1, [n]) - F.lit((dim + 1) / 2) * F.log(n)
    two = log_likelihood(n, parts[0][1] + parts[1][1], 2, [p[0] for p in parts]) - F.lit((2 * dim + 2) / 2) * F.log(n)
    return two - one


def _bic(n: int, sizes: list[int], spread: float, dim: int) -> float:
    k = len(sizes)
    variance = max(spread / (max(n - k, 1) * dim), 1e-12)
    likelihood = sum(m * math.log(m / n) for m in sizes) - n * dim / 2 * math.log(2 * math.pi * variance) - (n - k) * dim / 2
    return likelihood - k * (dim + 1) / 2 * math.log(n)


def split_in_task(most: int, iterations: int):
    """All further splits of one cluster that a task holds."""

    def halves(v: np.ndarray) -> np.ndarray | None:
        """Which members go left, or None if one cluster it is."""
        n, dim = v.shape
        if n < 3 and n <= most:
            return None
        d = ((v - v.mean(axis=0)) ** 2).sum(axis=1).round(12)
        c0 = v[d.argmax()]
        c1 = v[((v - c0) ** 2).sum(axis=1).round(12).argmax()]
        for i in range(iterations + 1):
            x, y = ((v - c0) ** 2).sum(axis=1), ((v - c1) ** 2).sum(axis=1)
            left = x <= y
            if i < iterations:
                c0, c1 = (v[at].mean(axis=0) if at.any() else c for at, c in ((left, c0), (~left, c1)))
        nl, least = int(left.sum()), min(int(left.sum()), n - int(left.sum()))
        if n <= most and (least < 2 or _bic(n, [nl, n - nl], float(np.where(left, x, y).sum()), dim) <= _bic(n, [n], float(d.sum()), dim)):
            return None
        if least < max(2, n * LEAST_SHARE):
            left = np.zeros(n, bool)
            left[np.argsort(x - y, kind="stable")[: n // 2]] = True
        return left

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        v, names = np.stack(group["v"].to_numpy()).astype(np.float64), group["cluster"].to_numpy(dtype=object).copy()
        todo = [np.arange(len(v))]
        while todo:
            at = todo.pop()
            left = halves(v[at])
            if left is not None:
                for part, bit in ((at[left], "0"), (at[~left], "1")):
                    names[part] += bit
                    todo.append(part)
        return pd.DataFrame({"sample_id": group["sample_id"], "node": group["node"], "cluster": names})

    return run


def grow(nodes: DataFrame, workspace: Workspace, name: str, most: int = MOST, iterations: int = ITERATIONS, gathered: int = GATHERED) -> DataFrame:
    """``sample_id, node, cluster`` for ``nodes (sample_id, node, v)``; a cluster's name is the bits of its splits."""
    first = nodes.select(F.size("v").alias("dim")).first()  # vectors have one dimension
    dim = first["dim"] if first else 1
    state = workspace.step(f"{name}-split-00", lambda: nodes.select("sample_id", "node", "v", F.lit("").alias("cluster"), F.lit(False).alias("done")))
    keys, turn = ["sample_id", "cluster"], 0
    while True:
        turn += 1
        still = state.where(~F.col("done"))
        large = still.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > gathered).drop("n")
        clusters = large.count()
        if not clusters:
            kinds = [f"{c} {state.schema[c].dataType.simpleString()}" for c in ("sample_id", "node")]
            finished = still.groupBy(*keys).applyInPandas(split_in_task(most, iterations), f"{', '.join(kinds)}, cluster string")
            return workspace.step(f"{name}-clusters", lambda: state.where("done").select("sample_id", "node", "cluster").unionByName(finished))
        hint = F.broadcast if clusters <= BROADCAST_ROWS else lambda df: df
        open_ = still.join(hint(large), keys)
        # two far members as first centres: the farthest from the mean, and the farthest from that one
        centre = open_.groupBy(*keys).agg(mean(dim).alias("m"), F.count(F.lit(1)).alias("n"))
        told = open_.join(hint(centre), keys).withColumn("far", F.struct(F.round(distance2(F.col("v"), F.col("m")), 12).alias("d"), (-F.hash("node")).alias("h"), F.col("node"), F.col("v")))
        start = told.groupBy(*keys, "m", "n").agg(F.max("far").alias("a"), F.sum("far.d").alias("spread"))
        told = open_.join(hint(start), keys).withColumn("far", F.struct(F.round(distance2(F.col("v"), F.col("a.v")), 12).alias("d"), (-F.hash("node")).alias("h"), F.col("node"), F.col("v")))
        pair = told.groupBy(*keys, "m", "n", "spread", F.col("a.v").alias("c0")).agg(F.max("far").alias("b")).select(*keys, "n", "spread", "c0", F.col("b.v").alias("c1"))
        for i in range(iterations):
            sides = open_.join(hint(pair.select(*keys, "c0", "c1")), keys).withColumn("left", distance2(F.col("v"), F.col("c0")) <= distance2(F.col("v"), F.col("c1")))
            moved = sides.groupBy(*keys, "left").agg(mean(dim).alias("c"))
            moved = moved.groupBy(*keys).agg(F.max(F.when(F.col("left"), F.col("c"))).alias("l"), F.max(F.when(~F.col("left"), F.col("c"))).alias("r"))
            pair = pair.join(moved, keys).select(*keys, "n", "spread", F.coalesce("l", "c0").alias("c0"), F.coalesce("r", "c1").alias("c1"))
        pair = workspace.step(f"{name}-pair-{turn:02d}", lambda pair=pair: pair)
        sides = open_.join(hint(pair), keys).withColumns({"x": distance2(F.col("v"), F.col("c0")), "y": distance2(F.col("v"), F.col("c1"))})
        sides = sides.withColumns({"left": F.col("x") <= F.col("y"), "along": F.col("x") - F.col("y")})
        judged = sides.groupBy(*keys, "n", "spread").agg(
            F.count_if("left").alias("nl"), F.count_if(~F.col("left")).alias("nr"), F.sum(F.when(F.col("left"), F.col("x")).otherwise(0.0)).alias("sl"),
            F.sum(F.when(~F.col("left"), F.col("y")).otherwise(0.0)).alias("sr"),
        )
        gain = _bic_gain(F.col("n"), F.col("spread"), [(F.greatest("nl", F.lit(1)), F.col("sl")), (F.greatest("nr", F.lit(1)), F.col("sr"))], dim)
        both = (F.col("nl") > 0) & (F.col("nr") > 0)
        judged = judged.withColumns({"split": (F.col("n") > most) | (both & (F.col("n") > 2) & (F.least("nl", "nr") > 1) & (gain > 0)), "even": F.least("nl", "nr") < F.greatest(F.lit(2), F.col("n") * LEAST_SHARE)})
        judged = workspace.step(f"{name}-judged-{turn:02d}", lambda judged=judged: judged.select(*keys, "split", "even", "n"))
        told = sides.select("sample_id", "node", "v", "cluster", "left", "along").join(hint(judged), keys)
        # a part that is nearly nothing (equal vectors, outliers) would need as many rounds as members: halves instead, by a hash where the line decides nothing
        odd = judged.where("even and split").agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.count_if(F.col("n") > HALVED), F.lit(0)).alias("large")).first()
        rest = told.where("not (even and split)").withColumn("half", F.col("left"))
        if odd["c"] > odd["large"]:
            place = F.percent_rank().over(Window.partitionBy(*keys).orderBy("along", F.hash("node"), "node"))
            rest = rest.unionByName(told.where(F.expr("even and split") & (F.col("n") <= HALVED)).withColumn("half", place < 0.5))
        if odd["large"]:  # too many members for one window: halves by hash
            rest = rest.unionByName(told.where(F.expr("even and split") & (F.col("n") > HALVED)).withColumn("half", F.hash("node", F.lit(turn)) % 2 == 0))
        after = rest.select("sample_id", "node", "v", F.when(F.col("split"), F.concat("cluster", F.when(F.col("half"), "0").otherwise("1"))).otherwise(F.col("cluster")).alias("cluster"), (~F.col("split")).alias("done"))
        before = state
        rest = before.join(hint(large), keys, "left_anti")
        state = workspace.step(f"{name}-split-{turn:02d}", lambda rest=rest, after=after: rest.unionByName(after))


def condense(members: DataFrame, generator: Callable[[DataFrame], DataFrame], level: int) -> DataFrame:
    """Clusters ``(sample_id, cluster, node, text)`` to nodes of the next level: ``sample_id, node, level, text, children``, one call each.

    ``generator`` adds ``text`` to rows ``(sample_id, node, children, texts)``; texts stand in the order of their nodes.
    """
    listed = members.groupBy("sample_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("node", "text"))).alias("m"))
    node = F.concat(F.lit(f"{level}:"), "cluster")
    rows = listed.select("sample_id", node.alias("node"), F.transform("m", lambda x: x["node"]).alias("children"), F.transform("m", lambda x: x["text"]).alias("texts"))
    return generator(rows).select("sample_id", "node", F.lit(level).alias("level"), "text", "children")


def build(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], generator: Callable[[DataFrame], DataFrame], workspace: Workspace, most: int = MOST, centres: list[DataFrame] | None = None, levels: int = LEVELS) -> DataFrame:
    """``sample_id, node, level, text, children, v`` of all levels over ``chunks (sample_id, node string, text)``.

    ``embed`` adds ``v``, an array of doubles.  With ``centres`` (a table ``(sample_id, cluster string, c)`` for each level) these are the clusters, and
    so many levels are made; else levels are added until every sample has a root (a cluster has two members at least, so a level has at most half the nodes).
    Each level is a written table: a job that is started again in the same workspace calls no generator twice for a level that it had written.
    """
    none = F.array().cast("array<string>")
    now = workspace.step("level-00", lambda: embed(chunks.select("sample_id", "node", F.lit(0).alias("level"), "text", none.alias("children"))))
    every = now
    for level in range(1, (len(centres) if centres is not None else levels) + 1):
        if centres is not None:
            clusters = assign(now, centres[level - 1]).select("sample_id", "node", "cluster")
        else:
            many = now.join(now.groupBy("sample_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"), "sample_id")
            if not many.limit(1).count():
                break
            few = now.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
            # few enough for one call: the root
            last = now.join(few.where(F.col("n").between(2, most)).drop("n"), "sample_id").select("sample_id", "node", F.lit("").alias("cluster"))
            large = now.join(few.where(F.col("n") > most).drop("n"), "sample_id")
            clusters = last.unionByName(grow(large.select("sample_id", "node", "v"), workspace, f"level-{level:02d}", most))
        members = now.select("sample_id", "node", "text").join(clusters, ["sample_id", "node"])
        now = workspace.step(f"level-{level:02d}", lambda members=members, level=level: embed(condense(members, generator, level)))
        every = every.unionByName(now)
    return every


def tree_topk(queries: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Nodes of all levels by cosine among those of the query's own sample: queries ``(query_id, sample_id, q_vec)`` to ``query_id, node, level, score, rank``."""
    known = nodes.select("sample_id", F.struct("level", "node").alias("chunk_id"), unit(F.col("v")).alias("c_vec"))
    hits = dense_topk(queries.select("query_id", "sample_id", unit(F.col("q_vec")).alias("q_vec")), known, k, "sample_id")
    return hits.select("query_id", F.col("chunk_id.level").alias("level"), F.col("chunk_id.node").alias("node"), "score", "rank")
