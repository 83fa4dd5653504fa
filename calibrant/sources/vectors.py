"""A stored vector index: a coarse quantiser, product-quantised residuals by cell, exact re-ranking, and an exact mode.

On disk, under one folder: ``rows (cell, id, code, v)`` sorted by cell, ``cells (cell, n, radius)``, a row for each cell and written segment, and the model
(centres and codebooks).  A search reads the codes of the probed cells, then the vectors of the candidates in the same cells; Parquet's statistics on ``cell``
skip the rest.  In the exact mode every cell whose bound reaches a query's k-th score is read: q.x <= q.c + |q| * radius for all x of a cell with centre c.

The model is fitted on at most ``SAMPLE_BYTES`` of vectors (those of smallest hash of their id); all vectors are indexed.  Vectors that are null, of another dimension than
the model's, or that hold null or non-finite entries are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.operators.search import QUERY_ROWS, bounded, dot, top
from calibrant.sources.datasets import exists

SAMPLE_BYTES, MOST_CELLS, PARTS, CODES, ROUNDS = 64 << 20, 4096, 16, 256, 8
#: Codes are turned into scores for so many (query, row) pairs at once.
TILE = 1 << 20
#: Scores are rounded to six digits, as those of the plain search.
SLACK = 2e-6


def k_means(x: np.ndarray, k: int, seed: int = 7, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds on a bounded sample; empty cells take the points farthest from their centres."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at, d = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        for j in range(x.shape[1]):
            c[:, j] = np.where(n > 0, np.bincount(at, weights=x[:, j], minlength=len(c)) / np.maximum(n, 1), c[:, j])
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[np.argsort(-d)[: len(empty)]]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the squared distance to it, in blocks."""
    at, d = np.empty(len(x), np.int64), np.empty(len(x))
    half = (c * c).sum(axis=1)
    step = max(1, TILE // len(c))
    for i in range(0, len(x), step):
        s = half[None, :] - 2 * x[i : i + step] @ c.T
        at[i : i + step] = s.argmin(axis=1)
        d[i : i + step] = s.min(axis=1) + (x[i : i + step] ** 2).sum(axis=1)
    return at, np.maximum(d, 0)


def finite(df: DataFrame, column: str, dim: int | None = None) -> DataFrame:
    ok = ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(F.col(column).isNotNull() & ok & ((F.size(column) == dim) if dim else (F.size(column) > 0)))


def _dense(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


class Model:
    """Centres of the cells and, for each part of the dimensions, the codewords of what a vector differs from its centre."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]):
        self.centres, self.books = centres, books
        self.cuts = np.cumsum([0, *(b.shape[1] for b in books)])

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, parts: int, seed: int) -> Model:
        centres = k_means(x, cells, seed)
        left = x - centres[nearest(x, centres)[0]]
        return cls(centres, [k_means(np.ascontiguousarray(p), CODES, seed + i) for i, p in enumerate(np.array_split(left, min(parts, x.shape[1]), axis=1))])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, distance to the centre) of each row."""
        cell, d = nearest(x, self.centres)
        left = x - self.centres[cell]
        codes = np.stack([nearest(left[:, a:b], book)[0] for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)], axis=1)
        return cell, codes.astype(np.uint8), np.sqrt(d)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each query's parts with all codewords: (query, part, code)."""
        out = np.zeros((len(q), len(self.books), CODES))
        for i, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books, strict=False)):
            out[:, i, : len(book)] = q[:, a:b] @ book.T
        return out


def _scan(shared, keep: int, by_code: bool):
    """Scores of a batch's rows for the queries that probe their cell; a query keeps the ``keep`` best of each cell and batch, and what rounding may tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, q, first, whose, ids = shared.value  # queries of cell c: whose[first[c]:first[c + 1]]
        tables = model.tables(q) if by_code else None
        for batch in batches:
            cell = batch.column(0).to_numpy()
            order = np.argsort(cell, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell[order])) + 1, [len(order)]]) if len(order) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                c = int(cell[order[a]])
                asked = whose[first[c] : first[c + 1]]
                step = max(keep, TILE // max(1, len(asked)))
                for i in range(a, b if len(asked) else a, step):
                    rows = order[i : min(b, i + step)]
                    taken = batch.column(2).take(pa.array(rows))
                    if by_code:
                        codes = np.frombuffer(b"".join(taken.to_pylist()), np.uint8).reshape(len(rows), -1)
                        scores = np.repeat((q[asked] @ model.centres[c])[:, None], len(rows), axis=1)
                        for p in range(codes.shape[1]):
                            scores += tables[asked, p][:, codes[:, p]]
                    else:
                        scores = q[asked] @ _dense(taken).T
                    kth = np.partition(scores, len(rows) - keep, axis=1)[:, len(rows) - keep] if len(rows) > keep else np.full(len(asked), -np.inf)
                    r, col = np.nonzero(scores >= kth[:, None] - SLACK)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(asked[r])), batch.column(1).take(pa.array(rows[col])), pa.array(np.full(len(r), c, np.int32)), pa.array(scores[r, col])], names=["query_id", "chunk_id", "cell", "score"])

    return run


class VectorIndex:
    """``VectorIndex.build(vectors, path)``, ``.append(vectors)``, ``.search(queries, k)``; ``VectorIndex(spark, path)`` opens one that is stored."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        if not exists(spark, f"{self.path}/model/_SUCCESS"):
            raise FileNotFoundError(f"no vector index in {path}")
        told = {r["name"]: r for r in spark.read.parquet(f"{self.path}/model").collect()}  # at most MOST_CELLS and PARTS * CODES vectors
        array = lambda name: np.frombuffer(bytes(told[name]["data"])).reshape(told[name]["shape"])
        self.model = Model(array("centres"), [array(f"book-{i:04d}") for i in range(len(told) - 2)])
        self.about = json.loads(bytes(told["about"]["data"]))

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, parts: int = PARTS, seed: int = 7) -> VectorIndex:
        """Over ``vectors (chunk_id, c_vec)``; as many cells as the root of the rows by default."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        clean = finite(vectors.select(F.col("chunk_id").alias("id"), F.col("c_vec").cast("array<double>").alias("v")), "v")
        sizes = clean.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
        if sizes is None:
            raise ValueError("there are no vectors to index")
        dim, n = sizes
        most = max(CODES, SAMPLE_BYTES // (8 * dim))
        sample = clean.where(F.size("v") == dim).orderBy(F.xxhash64("id")).limit(most).select("v").toArrow().combine_chunks().column("v").combine_chunks()
        model = Model.fit(_dense(sample), cells or int(min(MOST_CELLS, max(1, n**0.5))), parts, seed)
        about = json.dumps({"dim": dim, "id": vectors.schema["chunk_id"].dataType.simpleString()}).encode()
        stored = [("centres", model.centres.tobytes(), list(model.centres.shape)), ("about", about, [])]
        stored += [(f"book-{i:04d}", b.tobytes(), list(b.shape)) for i, b in enumerate(model.books)]
        spark.createDataFrame([(a, bytearray(b), c) for a, b, c in stored], "name string, data binary, shape array<int>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        index = cls(spark, path)
        index._write(vectors, "overwrite")
        return index

    def append(self, vectors: DataFrame) -> None:
        """More vectors under the same model."""
        self._write(vectors, "append")

    def _write(self, vectors: DataFrame, mode: str) -> None:
        model, dim = self.spark.sparkContext.broadcast(self.model), self.about["dim"]

        def encode(batches):
            for batch in batches:
                cell, codes, far = model.value.encode(_dense(batch.column(1))) if batch.num_rows else (np.zeros(0, np.int64), np.zeros((0, 1), np.uint8), np.zeros(0))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1), pa.array(far)], names=["cell", "id", "code", "v", "far"])

        clean = finite(vectors.select(F.col("chunk_id").cast(self.about["id"]).alias("id"), F.col("c_vec").cast("array<double>").alias("v")), "v", dim)
        told = clean.mapInArrow(encode, f"cell int, id {self.about['id']}, code binary, v array<double>, far double")
        # by cell and a hash, so that a cell with a third of all rows is many tasks' and files' work
        segment = f"{self.path}/rows/segment={0 if mode == 'overwrite' else 1 + self.segments()}"
        told.withColumn("h", F.xxhash64("id")).repartitionByRange("cell", "h").sortWithinPartitions("cell", "h").drop("h").write.mode("overwrite").parquet(segment)
        self.spark.read.parquet(segment).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).write.mode(mode).parquet(f"{self.path}/cells")

    def segments(self) -> int:
        return self.rows().agg(F.max("segment")).first()[0] or 0

    def rows(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")

    def radii(self) -> np.ndarray:
        """The radius of each cell, -inf where it is empty; at most MOST_CELLS rows."""
        out = np.full(len(self.model.centres), -np.inf)
        for r in self.spark.read.parquet(f"{self.path}/cells").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
            out[r["cell"]] = r["radius"]
        return out

    def _scanned(self, ids: pa.Array, q: np.ndarray, asked: np.ndarray, keep: int, by_code: bool, kind: str) -> DataFrame:
        """``query_id, chunk_id, cell, score`` of the cells that ``asked`` (query, cell) holds for."""
        cell, whose = np.nonzero(asked.T)
        first = np.searchsorted(cell, np.arange(asked.shape[1] + 1))
        shared = self.spark.sparkContext.broadcast((self.model, q, first, whose, ids))
        rows = self._of_cells(np.flatnonzero(asked.any(axis=0))).select("cell", "id", "code" if by_code else "v")
        return rows.mapInArrow(_scan(shared, keep, by_code), f"query_id {kind}, chunk_id {self.about['id']}, cell int, score double")

    def _of_cells(self, cells: np.ndarray) -> DataFrame:
        """Only files and row groups whose range of cells holds one of these are read."""
        ranges = np.split(cells, np.flatnonzero(np.diff(cells) > 1) + 1) if len(cells) else []
        test = F.lit(False)
        for r in ranges[:200]:
            test = test | F.col("cell").between(int(r[0]), int(r[-1]))
        if len(ranges) > 200:
            test = test | F.col("cell").between(int(ranges[200][0]), int(ranges[-1][-1]))
        return self.rows().where(test)

    def search(self, queries: DataFrame, k: int, probes: int = 16, exact: bool = False, factor: int = 10) -> DataFrame:
        """queries ``(query_id, q_vec)`` to ``query_id, chunk_id, score, rank`` by product, ties to the smaller id.

        The k best of the ``factor`` * k nearest by code in the ``probes`` nearest cells; with ``exact`` the k best of all.  Queries are taken ``QUERY_ROWS`` at a time.
        """
        kind = queries.schema["query_id"].dataType.simpleString()
        clean = finite(queries.select("query_id", F.col("q_vec").cast("array<double>").alias("q_vec")), "q_vec", self.about["dim"])
        blocks, out = max(1, -(-clean.count() // QUERY_ROWS)), None
        search: Callable = self._exact if exact else self._approximate
        for block in range(blocks):
            part = clean.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
            table = part.toArrow().combine_chunks()  # at most about QUERY_ROWS vectors
            ids, q = table.column("query_id").combine_chunks(), _dense(table.column("q_vec").combine_chunks())
            q = q if len(q) else np.zeros((0, self.about["dim"]))
            hits = search(part, ids, q, k, probes, factor, kind)
            out = hits if out is None else out.unionByName(hits)
        return top(out.withColumn("score", F.round("score", 6)), k, ["query_id"], [F.desc("score"), F.asc("chunk_id")])

    def _near(self, q: np.ndarray, probes: int, live: np.ndarray) -> np.ndarray:
        """Which cells a query probes: those nearest to it that hold anything."""
        c = self.model.centres
        d = np.where(live[None, :], (c * c).sum(axis=1)[None, :] - 2 * q @ c.T, np.inf)
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, np.argsort(d, axis=1, kind="stable")[:, :probes], True, axis=1)
        return out & live[None, :]

    def _approximate(self, part, ids, q, k, probes, factor, kind):
        asked = self._near(q, probes, np.isfinite(self.radii()))
        near = top(self._scanned(ids, q, asked, k * factor, True, kind), k * factor, ["query_id"], [F.desc("score"), F.asc("chunk_id")])
        near = near.select("query_id", F.col("chunk_id").alias("id"), "cell").distinct()
        rows = self._of_cells(np.flatnonzero(asked.any(axis=0))).select("cell", "id", "v").join(bounded(near, part, k * factor), ["cell", "id"])
        return rows.join(F.broadcast(part), "query_id").select("query_id", F.col("id").alias("chunk_id"), dot(F.col("q_vec"), F.col("v")).alias("score"))

    def _exact(self, part, ids, q, k, probes, factor, kind):
        radii = self.radii()
        asked = self._near(q, probes, np.isfinite(radii))
        first = self._scanned(ids, q, asked, k, False, kind)
        kth = top(first, k, ["query_id"], [F.desc("score")]).groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("c")).toArrow()  # a row for each query of the block
        known = dict(zip(kth.column("query_id").to_pylist(), zip(kth.column("kth").to_pylist(), kth.column("c").to_pylist(), strict=True), strict=True))
        theta = np.array([t if (t := known.get(i)) and t[1] >= k else (-np.inf, 0) for i in ids.to_pylist()]).reshape(-1, 2)[:, 0]
        length = np.sqrt((q * q).sum(axis=1))
        bound = q @ self.model.centres.T + length[:, None] * np.where(np.isfinite(radii), radii, -np.inf)[None, :]
        more = (bound * (1 + 1e-12) + 1e-9 >= theta[:, None] - SLACK) & ~asked & np.isfinite(radii)[None, :]
        out = first.select("query_id", "chunk_id", "score")
        return out.unionByName(self._scanned(ids, q, more, k, False, kind).select("query_id", "chunk_id", "score")) if more.any() else out

    def recall(self, queries: DataFrame, k: int, **options) -> float:
        """The share of the exact k best that the plain search finds."""
        best = self.search(queries, k, exact=True).select("query_id", "chunk_id")
        found = self.search(queries, k, **options).select("query_id", "chunk_id")
        all_, hit = best.count(), best.join(found, ["query_id", "chunk_id"], "left_semi").count()
        return hit / all_ if all_ else 1.0
