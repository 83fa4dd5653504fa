"""Collections of chunks: building, saving, loading, administration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.functions.text import ellipsis
from calibrant.operators import search as s
from calibrant.operators.chunk import chunk
from calibrant.operators.order import preceding
from calibrant.sources.datasets import exists
from calibrant.sources.tables import Workspace


class Collections:
    """``points (db_index, point_id, doc_id, chunk_id, chunk, original_text)`` and a small catalog."""

    def __init__(self, points: DataFrame, names: dict[int, str], default: int = 0):
        self.points, self.names, self.default = points, dict(names), default

    @classmethod
    def build(cls, docs: DataFrame, names: dict[int, str] | None = None, method: str = "sliding_window", **options) -> Collections:
        """docs ``(db_index, doc_id, text)``; point ids follow document and chunk order inside a collection.

        Every row is a document of its own, whether its id is repeated or null (nulls first, equal ids by text).
        """
        spark = docs.sparkSession
        cut = docs.select("db_index", "doc_id", chunk(F.col("text"), method, **options).alias("chunks"), ellipsis(F.col("text"), 100).alias("original_text"))
        cut = cut.withColumn("n", F.coalesce(F.size("chunks"), F.lit(0)).cast("long")).where("n > 0")
        placed = preceding(cut, ["db_index"], ["doc_id"], "n", "base", Workspace(spark), "documents")
        points = placed.select("db_index", "doc_id", F.posexplode("chunks").alias("chunk_id", "chunk"), "original_text", "base").withColumn("point_id", F.col("base") + F.col("chunk_id")).drop("base")
        if names is None:
            names = {r[0]: f"db_{r[0]}" for r in docs.select("db_index").distinct().collect()}
        return cls(points, names, min(names, default=0))

    def _of(self, db: int | None) -> DataFrame:
        db = self.default if db is None else db
        if db not in self.names:
            raise ValueError(f"unknown collection {db}; known: {sorted(self.names)}")
        return self.points.where(F.col("db_index") == db)

    def set_default(self, db: int) -> None:
        self._of(db)
        self.default = db

    def delete(self, db: int) -> None:
        self._of(db)
        del self.names[db]
        self.points = self.points.where(F.col("db_index") != db)
        if self.default == db and self.names:
            self.default = min(self.names)

    def append(self, docs: DataFrame, method: str = "sliding_window", **options) -> None:
        """Add documents of known collections; their point ids follow the highest ones, and nothing that is there changes."""
        new = Collections.build(docs, self.names, method, **options).points
        last = self.points.groupBy("db_index").agg((F.max("point_id") + 1).alias("next"))
        new = new.join(F.broadcast(last), "db_index", "left").withColumn("point_id", F.col("point_id") + F.coalesce("next", F.lit(0)))  # a row for each collection
        self.points = self.points.unionByName(new.select(*self.points.columns))

    def scroll(self, db: int | None = None, after: int | None = None, limit: int = 100) -> DataFrame:
        """The ``limit`` points that follow point ``after`` in a collection."""
        points = self._of(db)
        return (points if after is None else points.where(F.col("point_id") > after)).orderBy("point_id").limit(limit)

    def retrieve(self, wanted: DataFrame) -> DataFrame:
        """The payload of points ``(db_index, point_id)``; unknown ones are skipped."""
        return self.points.join(wanted.select("db_index", "point_id"), ["db_index", "point_id"])

    def details(self, embedding: str = "tfidf", features: int = 5000) -> DataFrame:
        """``db_index, db_name, points_count, vector_size, distance_metric, embedding_model`` of each collection."""
        names = self.points.sparkSession.createDataFrame(sorted(self.names.items()), "db_index int, db_name string")
        each = self.points.select("db_index", F.explode(F.array_distinct(s.terms(F.col("chunk"), s.english_stop_words(self.points.sparkSession)))).alias("term")).distinct()
        size = each.groupBy("db_index").agg(F.least(F.count(F.lit(1)), F.lit(features)).alias("vector_size"))
        points = self.points.groupBy("db_index").agg(F.count(F.lit(1)).alias("points_count"))
        out = names.join(points, "db_index", "left").join(size, "db_index", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return out.select("db_index", "db_name", zero("points_count"), zero("vector_size"), F.lit("Cosine").alias("distance_metric"), F.lit(embedding).alias("embedding_model"))

    def stats(self) -> DataFrame:
        return self.points.groupBy("db_index").agg(F.count(F.lit(1)).alias("points"), F.countDistinct("doc_id").alias("docs"))

    def search(self, queries: DataFrame, method: str = "bm25", k: int = 5, db: int | None = None) -> DataFrame:
        """queries ``(query_id, query)`` to ``query_id, rank, score, chunk, doc_id, chunk_id, method``."""
        points = self._of(db)
        docs = points.select(F.col("point_id").alias("doc_id"), F.col("chunk").alias("text"))
        if method == "bm25":
            hits = s.Bm25(docs).search(queries, k).withColumnRenamed("doc_id", "point_id")
        elif method == "matching":
            hits = s.match_topk(queries, points.select(F.col("point_id").alias("chunk_id"), "chunk"), k).withColumnRenamed("chunk_id", "point_id")
        elif method == "embeddings":
            hits = self._tfidf(docs, queries, k)
        elif method == "hybrid":
            pair = [points.select("point_id", "chunk").join(s.bounded(h, queries, 2 * k), "point_id") for h in (s.Bm25(docs).search(queries, 2 * k).withColumnRenamed("doc_id", "point_id"), self._tfidf(docs, queries, 2 * k))]
            both = s.hybrid(pair[0], pair[1], k, "chunk")
            first = points.select("point_id", "chunk").join(s.bounded(both.select("chunk").distinct(), queries, k), "chunk").groupBy("chunk").agg(F.min("point_id").alias("point_id"))
            hits = both.join(first, "chunk").drop("chunk")
        else:
            raise ValueError(f"unknown search method {method!r}; known: {s.SEARCHES}")
        return points.select("point_id", "chunk", "doc_id", "chunk_id", "original_text").join(s.bounded(hits, queries, k), "point_id").withColumn("method", F.lit(method))

    @staticmethod
    def _tfidf(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        return s.TfIdf(docs).search(queries, k).withColumnRenamed("doc_id", "point_id")

    def save(self, path: str) -> None:
        self.points.write.mode("overwrite").partitionBy("db_index").parquet(f"{path}/points")
        manifest = json.dumps({"names": self.names, "default": self.default})
        self.points.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str, new_path: str | None = None) -> Collections:
        """From ``path``; with ``new_path`` the points are copied there first and read from there, so the saved ones can go."""
        if not exists(spark, f"{path}/manifest") or not exists(spark, f"{path}/points"):
            raise FileNotFoundError(f"no saved collections in {path}")
        if new_path is not None:
            loaded = cls.load(spark, path)
            loaded.save(new_path)
            return cls.load(spark, new_path)
        m = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        return cls(spark.read.parquet(f"{path}/points"), {int(k): v for k, v in m["names"].items()}, m["default"])
