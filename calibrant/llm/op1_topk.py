"""Operator 1: exact top-k inner products by norm buckets (the LEMP scheme).

Vectors are range-partitioned by length into buckets.  Every query first meets the bucket of the longest vectors,
which gives it a lower bound theta on its k-th score.  For another bucket the local cosine threshold is
theta / (|q| * longest vector of the bucket): above 1 the whole bucket is skipped for that query; where it is high, the
bucket prunes by the query's largest coordinate (a unit vector with cosine t to q has that coordinate within
q_f * t +- sqrt((1 - t^2)(1 - q_f^2))); else by length.  What is left is multiplied in double precision; where
components are too large for that to be exact, products within the error of the k-th are computed again in integers.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part; rows with null ids take
no part (there is nothing to return); rows with the query's id are its own and no candidates of it; repeated candidates are
candidates each; rows that repeat a query's id and vector are one query; components and scores beyond 64 bits are the nearest 64-bit
number (ranks follow the exact scores); vectors of another dimension have no product with the query; an empty table gives an empty one;
other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: A bucket has a sixteenth of the rows within these bounds.
BUCKET_ROWS, QUERY_ROWS = (128, 8192), 2048
SCALE = 256
#: A score as a long and, so that longer ones are ordered, in pieces of 62 bits.
PAIR = "query_id long, vec_id long, score long, s2 long, s1 long, s0 long"
#: Relative error of a product in double precision, generously.
ERROR = 1e-11
LONG = (-(2**63), 2**63 - 1)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


def _none() -> pd.DataFrame:
    return pd.DataFrame({c.split(" ")[0]: np.zeros(0, np.int64) for c in PAIR.split(", ")})


def _best(q_ids, c_ids, scores, slack, k: int, exact) -> pd.DataFrame:
    """k best of each row of a score matrix (-inf: pruned), ties to the smaller id; scores may be off by ``slack``, then ``exact`` gives them."""
    low = (1 << 62) - 1
    kth = np.partition(scores, max(0, scores.shape[1] - k), axis=1)[:, max(0, scores.shape[1] - k)]
    r, c = np.nonzero((scores >= (kth - 2 * slack)[:, None]) & np.isfinite(scores))
    s = scores[r, c]
    if slack.any():
        wide = [exact(i, j) for i, j in zip(r.tolist(), c.tolist(), strict=True)]
        order = np.array(sorted(range(len(r)), key=lambda i: (r[i], -wide[i], c_ids[c[i]])), np.int64)
        s = np.array([min(max(x, LONG[0]), LONG[1]) for x in wide], np.int64)
        pieces = np.array([(x >> 124, (x >> 62) & low, x & low) for x in wide], np.int64).reshape(-1, 3)
    else:
        s = s.astype(np.int64)
        pieces = np.stack([s >> 63, (s >> 62) & low, s & low], axis=1)
        order = np.lexsort((c_ids[c], -s, r))
    r, c, s, pieces = r[order], c[order], s[order], pieces[order]
    top = np.arange(len(r)) - np.searchsorted(r, r) < k
    return pd.DataFrame({"query_id": q_ids[r[top]], "vec_id": c_ids[c[top]], "score": s[top], "s2": pieces[top, 0], "s1": pieces[top, 1], "s0": pieces[top, 2]})


def search_bucket(k: int):
    def run(queries: pd.DataFrame, bucket: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(bucket):
            return _none()
        bucket = bucket.sort_values(["norm2", "vec_id"], ascending=[False, True])
        c, ids = _matrix(bucket["v"]), bucket["vec_id"].to_numpy()
        q, q_ids, theta = _matrix(queries["v"]), queries["vec_id"].to_numpy(), queries["theta"].to_numpy(dtype=float, na_value=-np.inf)
        theta = np.where(theta <= 0, -np.inf, theta)
        mine = queries["v"].to_numpy()
        c_len, q_len = np.sqrt(bucket["norm2"].to_numpy(float)), np.sqrt(queries["norm2"].to_numpy(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            need = theta / q_len  # the least length that can reach theta
            local = need / c_len[0]  # the bucket's cosine threshold
        alive = ~(local > 1 + 1e-9)
        q, q_ids, theta, need, local, q_len, mine = (x[alive] for x in (q, q_ids, theta, need, local, q_len, mine))
        out = []
        unit = c / np.maximum(c_len, 1e-300)[:, None]
        by_coordinate = local > 0.5
        for start in range(0, len(q_ids), 256):
            at = slice(start, start + 256)
            keep = c_len[None, :] >= need[at, None] * (1 - 1e-9)  # length pruning
            turn = np.flatnonzero(by_coordinate[at]) + start
            if len(turn):
                f = np.abs(q[turn]).argmax(axis=1)
                x = q[turn, f] / q_len[turn]
                t = np.minimum(local[turn], 1.0)
                slack = np.sqrt(np.maximum(0, (1 - t * t) * (1 - x * x))) + 1e-9
                coord = unit[:, f].T
                keep[turn - start] &= (coord >= (x * t - slack)[:, None]) | (x * t <= 0)[:, None]
                keep[turn - start] &= (coord <= (x * t + slack)[:, None]) | ((x > 0) & (x >= t) | (x < 0))[:, None]
            some = np.flatnonzero(keep.any(axis=0))
            if not len(some):
                continue
            scores = np.where(keep[:, some], q[at] @ c[some].T, -np.inf)
            scores[ids[some][None, :] == q_ids[at, None]] = -np.inf
            slack = np.where(q_len[at] * c_len[0] * c.shape[1] < 2.0**53, 0.0, ERROR * q_len[at] * c_len[0])
            scores[scores < (theta[at] - slack - np.where((slack > 0) & np.isfinite(theta[at]), ERROR * np.abs(theta[at]), 0.0))[:, None]] = -np.inf
            raw = bucket["v"].to_numpy()
            exact = lambda i, j: sum(int(a) * int(b) for a, b in zip(mine[start + i], raw[some[j]], strict=True))  # noqa: B023, E731
            out.append(_best(q_ids[at], ids[some], scores, slack, k, exact))
        return pd.concat(out) if out else _none()

    return run


def top_k(vectors: DataFrame, is_query, scratch: Scratch, k: int = 5, scale: int = SCALE, bucket_rows: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row of ``vectors (vec_id, embedding)`` that ``is_query`` (a condition) holds for."""
    clean = vectors.select("vec_id", "embedding").where("vec_id is not null and size(embedding) > 0")
    clean = clean.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))))
    clean = clean.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))
    clean = clean.withColumns({"norm2": F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), "dim": F.size("v")})
    clean = scratch.keep(clean, "vectors")
    n, asked = clean.agg(F.count(F.lit(1)), F.count_if(F.expr(is_query) if isinstance(is_query, str) else is_query)).first()
    if not n:
        return clean.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    size = bucket_rows or min(max(n // 16, BUCKET_ROWS[0]), BUCKET_ROWS[1])
    buckets = clean.repartitionByRange(-(-n // size), F.desc("norm2"), "vec_id").withColumn("bucket", F.spark_partition_id())
    buckets = scratch.keep(buckets, "buckets")
    scratch.drop(clean)
    longest = buckets.groupBy("bucket", "dim").agg(F.max("norm2").alias("most"))
    first = longest.groupBy("dim").agg(F.max(F.struct("most", -F.col("bucket"))).alias("m")).select("dim", (-F.col("m.col2")).alias("bucket"))
    queries = buckets.where(is_query).drop("bucket").dropDuplicates(["vec_id", "v"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, asked // QUERY_ROWS))).cast("int"))

    def meet(pairs: DataFrame) -> DataFrame:
        """pairs: queries with the bucket that each shall meet."""
        sent = buckets.join(pairs.select("bucket", "dim", "block").distinct(), ["bucket", "dim"])
        pairs, sent = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (pairs, sent))  # columns of their own
        return pairs.groupBy("bucket", "dim", "block").cogroup(sent.groupBy("bucket", "dim", "block")).applyInPandas(search_bucket(k), PAIR)

    begun = scratch.keep(meet(queries.join(first, "dim").withColumn("theta", F.lit(None).cast("double"))), "first-scores")
    theta = begun.groupBy("query_id").agg(F.min("score").alias("t"), F.count(F.lit(1)).alias("c")).select(F.col("query_id").alias("vec_id"), F.when(F.col("c") >= k, F.col("t").cast("double")).alias("theta"))
    rest = longest.join(first.withColumnRenamed("bucket", "done"), "dim").where("bucket <> done").drop("done")
    later = queries.join(theta, "vec_id", "left").join(rest, "dim").where("theta is null or theta <= 0 or sqrt(norm2) * sqrt(most) >= theta * 0.999999")
    both = begun.union(meet(later.drop("most")))
    w = Window.partitionBy("query_id").orderBy(F.desc("s2"), F.desc("s1"), F.desc("s0"), "vec_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
