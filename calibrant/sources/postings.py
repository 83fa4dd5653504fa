"""A stored inverted index for BM25: postings in blocks by id range, appended as segments, deleted by tombstones, merged; searched with block maxima.

Under one folder, each table with a directory for every segment:

* ``postings (bucket, term, block, n, most_tf, least_len, docs, tfs, lens)``: the postings of a term whose ids lie in one range of ``WIDTH`` ids, in a directory for each bucket of
  terms, sorted by term. A search reads the buckets of its terms only. A block has at most ``WIDTH`` postings, so no word, however common, is gathered in one task.
* ``terms (bucket, term, df)``, ``lengths (block, doc_id, len)``, ``stats (n, total, base)``; a deletion writes negative counts.
* ``deleted (doc_id)``: documents of earlier segments that are gone.

A segment counts once its ``stats``, written last, are there; one that broke off before is never read and its number is used again. ``merge`` writes all that lives as one segment, a base: older ones are not
read any more. Ids are longs; rows with a null id are not indexed, an id that is there already or twice in a call is an error.

Blocks of all terms are aligned, so the sum of what each term can give at most in a block bounds the score of all its documents. A search scores the most promising blocks of each
query, takes the k-th score as a threshold, and then scores those blocks only whose bound reaches it. Documents without any of the words score 0 and stand above negative scores: they are
found by going through the id ranges from the smallest on, in steps that grow ``STEP``-fold, until enough documents with a score of at least 0 are there.

Blocks are what is exchanged, as arrays: a task gets the postings of an id range and its live documents, scores them for all queries that ask for the range by sparse products, and hands
on k documents of each query. No row for a posting, or for a document and query, is made.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.functions.text import tokens
from calibrant.operators.search import BROADCAST_ROWS, K1, QUERY_ROWS, B, _Best, _blocks, _flat, _sparse_scores, _tallied, small, top
from calibrant.sources.datasets import exists
from calibrant.sources.tables import Workspace

WIDTH, BUCKETS, FIRST_BLOCKS, STEP = 4096, 64, 4, 8
#: Scores are rounded to six digits; a bound must be that much smaller than a threshold to count.
SLACK = 2e-6


def fraction(tf: Column, length: Column, avgdl: float) -> Column:
    """What a posting gives for each unit of its term's weight; grows with tf, falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(avgdl)))


class InvertedIndex:
    """``InvertedIndex.create(spark, path)``, then ``append``, ``delete``, ``merge``, ``search``; ``InvertedIndex(spark, path)`` opens one that is stored."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        if not exists(spark, f"{self.path}/about/_SUCCESS"):
            raise FileNotFoundError(f"no inverted index in {path}")
        about = json.loads(spark.read.text(f"{self.path}/about").first()[0])
        self.width, self.buckets = about["width"], about["buckets"]
        self._seen: tuple[list[int], DataFrame | None] | None = None

    @classmethod
    def create(cls, spark: SparkSession, path: str, width: int = WIDTH, buckets: int = BUCKETS) -> InvertedIndex:
        if exists(spark, f"{path.rstrip('/')}/about/_SUCCESS"):
            raise FileExistsError(f"there is an index in {path}")
        spark.createDataFrame([(json.dumps({"width": width, "buckets": buckets}),)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}/about")
        return cls(spark, path)

    # ---- tables ------------------------------------------------------------------------------------------------

    def segments(self) -> list[int]:
        """The segments that count: from the last base on."""
        if not exists(self.spark, f"{self.path}/stats"):
            return []
        rows = self._table("stats").select("segment", "base").collect()  # a row for each segment
        base = max((r["segment"] for r in rows if r["base"]), default=0)
        return sorted(r["segment"] for r in rows if r["segment"] >= base)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").option("recursiveFileLookup", "false").parquet(f"{self.path}/{name}")

    def _read(self, name: str, schema: str, segments: list[int] | None = None) -> DataFrame:
        segments = (self._seen[0] if self._seen else self.segments()) if segments is None else segments
        there = [f"{self.path}/{name}/segment={i}" for i in segments if exists(self.spark, f"{self.path}/{name}/segment={i}/_SUCCESS")]
        if not there:
            return self.spark.createDataFrame([], f"{schema}, segment int")
        return self.spark.read.schema(f"{schema}, segment int").option("basePath", f"{self.path}/{name}").parquet(*there)

    POSTINGS = "term string, block long, n int, most_tf int, least_len int, docs array<long>, tfs array<int>, lens array<int>, bucket int"
    LISTED = "array<struct<doc_id: long, tf: int, len: int>>"
    TERMS, LENGTHS, STATS, DELETED = "term string, df long, bucket int", "block long, doc_id long, len int", "n long, total long, base boolean", "doc_id long"

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows ``(doc_id, segment)`` without those that a later segment deletes."""
        gone = self._seen[1] if self._seen else self._gone()
        return rows if gone is None else rows.join(gone, "doc_id", "left").where("since is null or since <= segment").drop("since")

    def _gone(self) -> DataFrame | None:
        gone = self._read("deleted", self.DELETED)
        n = gone.limit(BROADCAST_ROWS + 1).count()
        if not n:
            return None
        gone = gone.groupBy("doc_id").agg(F.max("segment").alias("since"))
        return F.broadcast(gone) if n <= BROADCAST_ROWS else gone

    def snapshot(self) -> InvertedIndex:
        """The index as it is now, whatever is added to it meanwhile."""
        out = copy.copy(self)
        out._seen = (self.segments(), None)
        out._seen = (out._seen[0], out._gone())
        return out

    def lengths(self) -> DataFrame:
        """``block, doc_id, len`` of all documents."""
        return self._live(self._read("lengths", self.LENGTHS)).select("block", "doc_id", "len")

    def size(self) -> tuple[int, int]:
        """Documents and words."""
        r = self._read("stats", self.STATS).agg(F.sum("n"), F.sum("total")).first()
        return r[0] or 0, r[1] or 0

    def _block(self) -> Column:
        return F.expr(f"(doc_id - pmod(doc_id, {self.width}L)) div {self.width}L")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    # ---- writing -----------------------------------------------------------------------------------------------

    def _next(self) -> int:
        return max(self.segments(), default=0) + 1

    def _write(self, segment: int, postings: DataFrame, lengths: DataFrame, base: bool) -> None:
        """postings ``(term, block, p array<struct<doc_id, tf, len>>)``, any number of rows for a term and block; lengths ``(doc_id, len)``."""
        block = self._block()
        place = lambda name: f"{self.path}/{name}/segment={segment}"
        # dealt by ranges first: a term's block is in one of them, so it is gathered there and exchanged once
        keys = ["bucket", "term", "block"]
        blocks = postings.withColumn("bucket", self._bucket()).repartitionByRange(*keys).groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("p"))).alias("p"))
        blocks = blocks.select("term", "block", F.size("p").alias("n"), F.array_max("p.tf").alias("most_tf"), F.array_min("p.len").alias("least_len"), F.col("p.doc_id").alias("docs"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens"), "bucket")
        blocks.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("bucket").parquet(place("postings"))
        told = self._read("postings", self.POSTINGS, [segment]).groupBy("bucket", "term").agg(F.sum(F.col("n").cast("long")).alias("df"))
        told.select("term", "df", "bucket").repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(place("terms"))
        lengths.select(block.alias("block"), "doc_id", F.col("len").cast("int").alias("len")).repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(place("lengths"))
        self._commit(segment, self._read("lengths", self.LENGTHS, [segment]).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")), base)

    def _commit(self, segment: int, stats: DataFrame, base: bool) -> None:
        stats.select("n", "total", F.lit(base).alias("base")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/segment={segment}")

    def append(self, docs: DataFrame) -> None:
        """Add ``docs (doc_id, text)`` as a segment; a null text is a document without words."""
        words = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("words"))
        ids = words.select("doc_id").unionByName(self.lengths().select("doc_id").join(words.select("doc_id"), "doc_id", "left_semi"))
        twice = [r[0] for r in ids.groupBy("doc_id").count().where("count > 1").orderBy("doc_id").limit(5).collect()]
        if twice:
            raise ValueError(f"documents are indexed already, or given twice: {twice}; delete them first")
        postings = words.mapInArrow(_posted(self.width), f"term string, block long, p {self.LISTED}")
        self._write(self._next(), postings, words.select("doc_id", F.size("words").alias("len")), False)

    def _postings(self, rows: DataFrame) -> DataFrame:
        """``doc_id, len, term, tf`` of blocks, without deleted documents."""
        each = rows.select("segment", "term", F.explode(F.arrays_zip("docs", "tfs", "lens")).alias("p"))
        return self._live(each.select("segment", "term", F.col("p.docs").alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))).drop("segment")

    def delete(self, ids: DataFrame) -> None:
        """Tombstones for documents ``(doc_id)``; ids that are not there are skipped."""
        segment = self._next()
        gone = self.lengths().join(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
        gone = Workspace(self.spark, f"{self.path}/steps/{segment}").step("gone", lambda: gone)
        blocks = self._read("postings", self.POSTINGS).join(gone.select("block").distinct(), "block", "left_semi")
        words = self._postings(blocks).join(gone.select("doc_id"), "doc_id", "left_semi").groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
        words.select("term", "df", self._bucket().alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/terms/segment={segment}")
        gone.select("doc_id").write.mode("overwrite").parquet(f"{self.path}/deleted/segment={segment}")
        self._commit(segment, gone.agg((-F.count(F.lit(1))).alias("n"), F.coalesce(-F.sum("len"), F.lit(0)).alias("total")), False)

    def merge(self) -> None:
        """All segments into one; the files of the old ones are left to ``vacuum``, as searches may still read them."""
        segments = self.segments()
        if len(segments) > 1:
            each = self._postings(self._read("postings", self.POSTINGS, segments))
            self._write(segments[-1] + 1, each.select("term", self._block().alias("block"), F.array(F.struct("doc_id", "tf", "len")).alias("p")), self.lengths().select("doc_id", "len"), True)

    def vacuum(self) -> None:
        """Delete what no search that starts now would read."""
        base = min(self.segments(), default=0)
        for name in ("stats", "postings", "terms", "lengths", "deleted"):
            for i in range(1, base):
                Workspace(self.spark, f"{self.path}/{name}/segment={i}").drop()

    # ---- searching ---------------------------------------------------------------------------------------------

    def idf(self, asked: DataFrame | None = None) -> DataFrame:
        """``term, df, idf`` of all terms, or of those in ``asked (term)``, from their buckets only."""
        n, _ = self.size()
        terms = self._read("terms", self.TERMS)
        if asked is not None:
            terms = self._of_terms(terms, asked)
        terms = terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return terms.select("term", "df", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))

    def _of_terms(self, rows: DataFrame, asked: DataFrame) -> DataFrame:
        """The rows of the asked terms: buckets are chosen by directory, row groups by name where the terms are few."""
        buckets = [r[0] for r in asked.select(self._bucket().alias("bucket")).distinct().collect()]  # at most ``buckets``
        words = [r[0] for r in asked.select("term").distinct().limit(501).collect()]
        rows = rows.where(F.col("bucket").isin(buckets))
        return rows.where(F.col("term").isin(words)) if len(words) <= 500 else rows.join(F.broadcast(asked.select("term").distinct()) if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else asked.select("term").distinct(), "term", "left_semi")

    def search(self, queries: DataFrame, k: int, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
        """queries ``(query_id, query)`` to ``query_id, doc_id, score, rank`` over all documents, ties to the smaller id: the results of ``search.Bm25``.

        ``QUERY_ROWS`` queries at a time, whose words and weights all tasks get.
        """
        if self._seen is None:
            return self.snapshot().search(queries, k, first_blocks)
        n, total = self.size()
        work = Workspace(self.spark, None)
        asked = work.step("queries", lambda: queries.select("query_id", "query").dropDuplicates(["query_id"]))
        if not n:
            return asked.limit(0).select("query_id", F.lit(0).cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
        # the live documents of each id range, in the order of their ids, at most ``width``
        each = self._live(self._read("lengths", self.LENGTHS)).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "len", "segment"))).alias("d"))
        live = work.step("live", lambda: each.select("block", *[F.col(f"d.{c}").alias(f"{c}s") for c in ("doc_id", "len", "segment")]))
        out = None
        for i, part in enumerate(_blocks(asked) if asked.limit(QUERY_ROWS + 1).count() > QUERY_ROWS else [asked]):
            found = self._search(part, k, first_blocks, n, max(total / n, 1e-300), live, Workspace(self.spark, f"{work.root}/part-{i}"))
            out = found if out is None else out.unionByName(found)
        return out

    def _search(self, asked: DataFrame, k: int, first_blocks: int, n: int, avgdl: float, live: DataFrame, work: Workspace) -> DataFrame:
        told = asked.select("query_id", tokens(F.col("query")).alias("words")).toArrow().combine_chunks()
        ids, (query, words) = told.column("query_id").combine_chunks(), _flat(told.column("words").combine_chunks())
        terms = pc.unique(words)
        coded = self.spark.createDataFrame(pa.table({"term": terms, "code": pa.array(range(len(terms)), pa.int32())}))
        held = {r["term"]: r["df"] for r in self._of_terms(self._read("terms", self.TERMS), coded).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").collect()} if len(terms) else {}
        df = np.array([held.get(t, 0) for t in terms.to_pylist()], np.float64)
        query, code, qtf = _tallied(query, pc.index_in(words, value_set=terms).to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(terms)))
        there = df[code] > 0
        query, code = query[there], code[there]
        weight = qtf[there] * np.log((n - df[code] + 0.5) / (df[code] + 0.5))
        order = np.argsort(code, kind="stable")
        shared = self.spark.sparkContext.broadcast((len(ids), np.searchsorted(code[order], np.arange(len(terms) + 1)), query[order], weight[order]))
        blocks = self._of_terms(self._read("postings", self.POSTINGS), coded).join(F.broadcast(coded), "term")
        order = [F.desc("score"), F.asc("doc_id")]
        no = lambda x: pa.array(x.astype(np.int32))

        def scores(asking: DataFrame, rows: DataFrame, needy: np.ndarray | None = None) -> DataFrame:
            """``no, doc_id, score``: the k best documents of each query among ``asking (block, nos)``, with the postings ``rows``."""
            head = live.join(asking, "block").select("block", F.lit(-1).alias("code"), F.lit(0).alias("segment"), F.col("doc_ids").alias("docs"), F.col("lens").alias("tfs"), "segments", "nos")
            none = F.lit(None).cast("array<int>")
            rows = rows.select("block", "code", "segment", "docs", "tfs", none.alias("segments"), none.alias("nos"))
            dealt = head.unionByName(rows).repartition("block").sortWithinPartitions("block", "code")
            return top(dealt.mapInArrow(_scored(shared, k, avgdl, needy), "no int, doc_id long, score double"), k, ["no"], order).drop("rank")

        def positive(pairs: DataFrame) -> DataFrame:
            asking = small(pairs.groupBy("block").agg(F.collect_list("no").alias("nos")))
            return scores(asking, blocks.join(asking.select("block"), "block", "left_semi"))

        # block maxima: headers only, no postings; of one term's blocks in several segments a document is in one at most (or its other copies are deleted)
        good = weight > 0
        weights = self.spark.createDataFrame(pa.table({"no": no(query[good]), "code": no(code[good]), "w": weight[good]}))
        most = blocks.groupBy("block", "code").agg(F.max(fraction(F.col("most_tf"), F.col("least_len"), avgdl)).alias("most"))
        bounds = most.join(F.broadcast(weights), "code").groupBy("no", "block").agg(F.sum(F.col("w") * F.col("most")).alias("most"))
        bounds = work.step("bounds", lambda: bounds)
        start = work.step("start", lambda: top(bounds, first_blocks, ["no"], [F.desc("most"), F.asc("block")]).select("no", "block"))
        begun = work.step("first", lambda: positive(start))
        theta = begun.groupBy("no").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("theta"))
        later = bounds.join(F.broadcast(theta), "no", "left").where(F.col("most") >= F.greatest(F.coalesce("theta", F.lit(0.0)), F.lit(0.0)) - SLACK)
        later = work.step("later", lambda: later.join(start, ["no", "block"], "left_anti").select("no", "block"))
        found = work.step("found", lambda: top(begun.unionByName(positive(later)), k, ["no"], order).drop("rank"))

        # queries with fewer than k positive scores: zeros, and negative ones behind them
        full = {r[0] for r in found.where("score > 0").groupBy("no").count().where(F.col("count") >= k).select("no").collect()}  # at most QUERY_ROWS
        needy, after, width, turn, zeros = np.array([i for i in range(len(ids)) if i not in full]), None, 1, 0, None
        while len(needy):
            turn += 1
            left = F.lit(True) if after is None else F.col("block") > after
            last = live.where(left).select("block").orderBy("block").limit(width).agg(F.max("block")).first()[0]
            if last is None:
                break
            part = left & (F.col("block") <= last)
            asking = live.where(part).select("block", F.lit(None).cast("array<int>").alias("nos"))
            # a turn's k best of each query are enough: those of 0 with the smallest ids, or the best negative ones
            best = work.step(f"zeros-{turn}", lambda asking=asking, part=part: scores(asking, blocks.where(part), needy))
            zeros = best if zeros is None else zeros.unionByName(best)
            done = {r[0] for r in zeros.where("score >= 0").groupBy("no").count().where(F.col("count") >= k).select("no").collect()}
            needy = np.array([i for i in needy.tolist() if i not in done])
            after, width = last, width * STEP
        out = found if zeros is None else found.unionByName(zeros).dropDuplicates(["no", "doc_id"])
        named = self.spark.createDataFrame(pa.table({"no": pa.array(range(len(ids)), pa.int32()), "query_id": ids}))
        return top(out, k, ["no"], order).join(F.broadcast(named), "no").select("query_id", "doc_id", "score", "rank")


def _posted(width: int):
    """Documents ``(doc_id, words)`` to the postings of each batch, a row for each term and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lens = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy().astype(np.int32)
            row, words = _flat(batch.column(1))
            coded = words.dictionary_encode()
            row, code, tf = _tallied(row, coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary)))
            block = ids[row] // width
            order = np.lexsort((block, code))
            row, code, tf, block = row[order], code[order], tf[order], block[order]
            first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1]))[: len(code)])
            each = pa.StructArray.from_arrays([pa.array(ids[row]), pa.array(tf.astype(np.int32)), pa.array(lens[row])], ["doc_id", "tf", "len"])
            listed = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), each)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), pa.array(block[first]), listed], names=["term", "block", "p"])

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, which stand together, one after the other."""
    parts: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:]):
            if parts and b > a and parts[0].column(0)[0].as_py() != block[a]:
                yield pa.Table.from_batches(parts)
                parts = []
            if b > a:
                parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


def _scored(shared, k: int, avgdl: float, needy: np.ndarray | None):
    """Blocks, each with its live documents (code -1) before its postings, to the ``k`` best documents of each query in all the task's blocks.

    A block is asked for by the queries ``needy``, whatever their scores, or by those of its row, for positive scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, query, weight = shared.value
        best = _Best(n, k)
        for rows in _ranges(batches):
            head = rows.slice(0, 1)
            if head.column("code")[0].as_py() != -1:  # no live document
                continue
            ids, lens, segments, nos = (head.column(c).combine_chunks().flatten() for c in ("docs", "tfs", "segments", "nos"))
            known, lens, segments, nos = (x.to_numpy(zero_copy_only=False) for x in (ids, lens, segments, nos))
            nos = np.sort(nos) if needy is None else needy
            asked = np.zeros(n, bool)
            asked[nos] = True
            mine = asked[query]
            place = np.cumsum(asked) - 1
            own = (nos, np.concatenate([[0], np.cumsum(mine)])[first], place[query[mine]], weight[mine], None)
            rest = rows.slice(1)
            entry, docs = _flat(rest.column("docs").combine_chunks())
            docs, tf = docs.to_numpy(zero_copy_only=False), rest.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            code, segment = (rest.column(c).to_numpy() for c in ("code", "segment"))
            at = np.minimum(np.searchsorted(known, docs), len(known) - 1)
            lives = (known[at] == docs) & (segments[at] == segment[entry])  # copies of other segments are deleted
            at, code, tf = at[lives], code[entry[lives]].astype(np.int64), tf[lives]
            order = np.argsort(at, kind="stable")
            at, code, tf = at[order], code[order], tf[order]
            value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[at] / avgdl))
            for start, end, scores in _sparse_scores(own, at, code, value, len(known)):
                if needy is None:
                    scores[scores <= 0] = -np.inf
                best.add(scores, ids.slice(start, end - start), nos)
        yield from (pa.RecordBatch.from_arrays(b.columns, names=["no", "doc_id", "score"]) for b in best.batch(pa.array(np.arange(n, dtype=np.int32))))

    return run
