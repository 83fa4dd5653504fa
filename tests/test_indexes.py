"""Trees of summaries, vector and inverted indexes, order and collections against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibrant.operators import search as s
from calibrant.operators import tree
from calibrant.operators.order import preceding
from calibrant.plans import models, systems
from calibrant.sources.index import Collections
from calibrant.sources.tables import Workspace
from calibrant.sources.vectors import VectorIndex


# ---- zero vectors, order, collections -----------------------------------------------------------------------------


@pytest.mark.parametrize("zeros", [1, 3, 40])
def test_dense_search_beside_zero_and_broken_vectors(spark, zeros):
    good = [(i, [1.0, i / 10]) for i in range(6)]
    bad = [(100 + i, [0.0, 0.0]) for i in range(zeros)] + [(500, [None, 1.0]), (501, [float("nan"), 1.0]), (502, None), (503, [float("inf"), 1.0])]
    chunks = spark.createDataFrame(good + bad, "chunk_id long, v array<double>").select("chunk_id", s.unit(F.col("v")).alias("c_vec"))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [None, 1.0])], "query_id long, v array<double>").select("query_id", s.unit(F.col("v")).alias("q_vec"))
    for group in (None, "g"):
        more = {"g": F.lit(1)} if group else {}
        got = s.dense_topk(asked.withColumns(more) if more else asked, chunks.withColumns(more) if more else chunks, 3, group)
        by = {}
        for x in got.collect():
            by.setdefault(x["query_id"], []).append((x["rank"], x["chunk_id"], x["score"]))
        assert [c for _, c, _ in sorted(by[1])] == [0, 1, 2] and [(c, x) for _, c, x in sorted(by[2])] == [(0, 0.0), (1, 0.0), (2, 0.0)] and 3 not in by


def test_preceding_sums_with_a_hot_value(spark):
    r = random.Random(2)
    rows = [(None if r.random() < 0.1 else r.randrange(2), 5 if r.random() < 0.9 else r.randrange(9), i, r.randrange(4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, x int, i int, w long").repartition(7)
    got = {x["i"]: x["before"] for x in preceding(df, ["g"], ["x", "i"], "w", "before", Workspace(spark)).collect()}
    total: dict = {}
    for g, x, i, w in sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2])):
        assert got[i] == total.get(g, 0)
        total[g] = total.get(g, 0) + w


def test_collections_of_repeated_and_null_ids(spark):
    rows = [(0, 1, "one two"), (0, 1, "one two"), (0, 1, "three"), (0, None, "four"), (0, None, "five"), (1, 7, ""), (1, 8, None), (1, 9, "six")]
    points = Collections.build(spark.createDataFrame(rows, "db_index int, doc_id long, text string"), {0: "a", 1: "b"}).points.collect()
    assert sorted(x["chunk"] for x in points) == ["five", "four", "one two", "one two", "six", "three"]
    assert sorted(x["point_id"] for x in points if x["db_index"] == 0) == [0, 1, 2, 3, 4] and [x["point_id"] for x in points if x["db_index"] == 1] == [0]
    assert {x["doc_id"] for x in points if x["point_id"] < 2 and x["db_index"] == 0} == {None}


# ---- trees --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("gathered", [2048, 30])
def test_grown_clusters_follow_the_data(spark, gathered):
    r = random.Random(1)
    rows = [(s_, f"{i:05d}", [(5.0 if j == i % 4 else 0.0) + r.gauss(0, 0.05) for j in range(6)]) for s_, n in ((0, 3), (1, 48)) for i in range(n)]
    rows += [(2, f"{i:05d}", [1.0] * 6) for i in range(70)]  # equal vectors: only the bound splits them
    got = tree.grow(spark.createDataFrame(rows, "sample_id long, node string, v array<double>"), Workspace(spark), "x", most=20, gathered=gathered).collect()
    assert len(got) == len(rows)
    by: dict = {}
    for x in got:
        by.setdefault((x["sample_id"], x["cluster"]), []).append(int(x["node"]))
    assert sorted(len(v) for k, v in by.items() if k[0] == 0) == [3]
    assert sorted(tuple(sorted({i % 4 for i in v})) for k, v in by.items() if k[0] == 1) == [(0,), (1,), (2,), (3,)]
    assert all(2 <= len(v) <= 20 for k, v in by.items() if k[0] == 2)


def test_a_tree_has_one_root_and_is_not_made_twice(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    rows = [(s_, f"{i:05d}", f"alpha w{i % 3} w{i}") for s_, n in ((1, 30), (2, 1), (3, 5)) for i in range(n)]
    chunks = spark.createDataFrame(rows, "sample_id long, node string, text string")
    embed = lambda df: models.embed(df, models.hashed_embedder(8), "text", "v").drop("v_error")

    def condense(df):
        count = F.udf(lambda t: calls.add(1) or t, "string")
        return df.withColumn("text", count(F.array_join(F.transform("texts", lambda x: F.substring_index(x, " ", 2)), " ")))

    nodes = tree.build(chunks, embed, condense, Workspace(spark, f"file://{tmp_path}/t"), most=6).collect()
    made = calls.value
    again = tree.build(chunks, embed, condense, Workspace(spark, f"file://{tmp_path}/t"), most=6).collect()
    assert sorted(map(repr, nodes)) == sorted(map(repr, again)) and calls.value == made > 0
    for sample, n in ((1, 30), (2, 1), (3, 5)):
        mine = {x["node"]: x for x in nodes if x["sample_id"] == sample}
        assert sum(x["level"] == 0 for x in mine.values()) == n
        below = [c for x in mine.values() for c in x["children"]]
        assert len(below) == len(set(below)) and len(set(mine) - set(below)) == 1  # every node but the root has one parent
        assert all(len(x["children"]) <= 6 for x in mine.values())


def test_raptor_answers_from_its_own_tree(spark):
    text = ". ".join(f"Topic{i % 5} statement number {i} with some more words to fill a sentence" for i in range(120))
    samples = spark.createDataFrame([(1, "What is Topic3?", ["A", "B"], text), (2, "short", ["A", "B"], "tiny"), (3, "none", ["A", "B"], None)], "sample_id long, question string, options array<string>, context string")
    got = {x["sample_id"]: x for x in systems.RaptorLlm().answer(samples).collect()}
    assert got[1]["raptor_used"] and got[1]["context"].startswith("RAPTOR Analysis: ") and got[1]["technique"] == "rag"
    assert not got[2]["raptor_used"] and got[2]["context"] == "tiny" and not got[3]["raptor_used"]
    nodes = systems.RaptorLlm().tree(samples.where("sample_id = 1")).collect()
    assert max(x["level"] for x in nodes) >= 1 and sum(x["level"] == 0 for x in nodes) > 8


# ---- vectors ------------------------------------------------------------------------------------------------------


def clustered(n: int, dim: int = 16, seed: int = 4) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, dim))
    x = centres[r.integers(0, 20, n)] + 0.25 * r.normal(size=(n, dim))
    x[: n // 3] = x[0]  # a third of all rows is one vector
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_vector_index(spark, tmp_path):
    x = clustered(2400)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    broken = [(9000, None), (9001, [1.0]), (9002, [None] * 16), (9003, [float("nan")] * 16)]
    chunks = spark.createDataFrame(rows + broken, "chunk_id long, c_vec array<double>")
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 2400, 40)] + [(7777, [float("nan")] * 16), (7778, None)], "query_id long, q_vec array<double>")
    path = f"file://{tmp_path}/v"
    index = VectorIndex.build(chunks.where("chunk_id % 2 = 0"), path)
    assert index.search(asked, 5, exact=True).where("chunk_id % 2 = 1").count() == 0
    index.append(chunks.where("chunk_id % 2 = 1"))
    index = VectorIndex(spark, path)
    assert index.rows().count() == 2400
    want = {tuple(r) for r in s.dense_topk(asked, chunks, 5).select("query_id", "chunk_id", "score", "rank").collect()}
    assert {tuple(r) for r in index.search(asked, 5, probes=2, exact=True).select("query_id", "chunk_id", "score", "rank").collect()} == want
    other = asked.where("query_id >= 800")  # not the vector that a third of all rows shares, whose ties only ids tell apart
    assert index.recall(other, 5, probes=8) >= 0.95
    with pytest.raises(FileNotFoundError):
        VectorIndex(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="no vectors"):
        VectorIndex.build(chunks.where("chunk_id = 9000"), f"file://{tmp_path}/e")


def test_vector_search_reads_the_cells_it_probes(spark, tmp_path):
    chunks = spark.createDataFrame([(i, [math.cos(i / 90), math.sin(i / 90)]) for i in range(500)], "chunk_id long, c_vec array<double>")
    index = VectorIndex.build(chunks, f"file://{tmp_path}/v", parts=2)
    plan = index._of_cells(np.array([1, 2, 3, 9]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(cell,1)" in plan


# ---- postings -----------------------------------------------------------------------------------------------------


def plain_bm25(docs: dict, queries: list[tuple], k: int) -> set:
    words = {i: (t or "").split() for i, t in docs.items()}
    n, avgdl = len(docs), sum(map(len, words.values())) / len(docs)
    df: dict = {}
    for w in words.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = set()
    for q, text in queries:
        scored = []
        for i, w in words.items():
            x = 0.0
            for term in (text or "").split():
                tf = w.count(term)
                if tf:
                    x += math.log((n - df[term] + 0.5) / (df[term] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl))
            scored.append((-round(x, 6), i))
        out |= {(q, i, -x + 0.0, r + 1) for r, (x, i) in enumerate(sorted(scored)[:k])}
    return out


def test_inverted_index(spark, tmp_path):
    from calibrant.sources.postings import InvertedIndex

    r = random.Random(6)
    vocabulary = ["the", "of", "all"] + [f"w{i}" for i in range(60)]
    weights = [60, 40, 25] + [1] * 60

    def make(ids):
        return {i: " ".join(["all", *r.choices(vocabulary, weights, k=r.randrange(1, 30))]) for i in ids}

    docs = make([*range(-40, 90), *range(1000, 1100)]) | {5000: None, 5001: "", 5002: "w1 " * 3000}
    more, other = make(range(90, 200)), make(range(20, 60))
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    queries = [(1, "w1 w2 w3"), (2, "the of"), (3, "all"), (4, "w5 w5 the"), (5, "nothing known"), (6, ""), (7, None), (8, "all w7"), (9, "the w9 all of")]
    asked = spark.createDataFrame(queries, "query_id long, query string")
    path = f"file://{tmp_path}/p"
    index = InvertedIndex.create(spark, path, width=64, buckets=4)
    assert index.search(asked, 5).count() == 0
    index.append(frame(docs))

    def same(live, k=7):
        got = {tuple(x) for x in InvertedIndex(spark, path).search(asked, k).select("query_id", "doc_id", "score", "rank").collect()}
        want = plain_bm25(live, queries, k)
        assert {(q, i, rank) for q, i, _, rank in got} == {(q, i, rank) for q, i, _, rank in want}
        assert sorted(x for *_, x, _ in got) == pytest.approx(sorted(x for *_, x, _ in want), abs=2e-6)

    index.append(frame(more))
    index.delete(spark.createDataFrame([(i,) for i in [*range(10, 60), 4444]], "doc_id long"))
    live = {i: t for i, t in (docs | more).items() if not 10 <= i < 60}
    same(live)
    with pytest.raises(ValueError, match="indexed already"):
        index.append(frame({90: "again"}))
    index.append(frame(other))  # ids that were deleted come back
    live |= other
    same(live, 300)  # more than there are: all of them, negative ones too
    files = InvertedIndex(spark, path).segments()
    index.merge()
    index.vacuum()
    assert len(InvertedIndex(spark, path).segments()) == 1 and len(files) == 4
    (tmp_path / "p" / "postings" / "segment=99").mkdir()  # a segment that broke off
    same(live, 3)
    index = InvertedIndex(spark, path)
    plan = index._of_terms(index._read("postings", index.POSTINGS), spark.createDataFrame([("w1",)], "term string"))
    assert len(plan.select("bucket").distinct().collect()) == 1 and "PartitionFilters" in plan._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(FileExistsError):
        InvertedIndex.create(spark, path)


def test_no_search_gathers_the_corpus(spark):
    """Hits are broadcast, texts are scanned in place; idf goes with the asked words; no window runs over all rows."""
    docs = spark.createDataFrame([(i, f"w{i % 7} x{i}") for i in range(300)], "doc_id long, text string")
    samples = spark.createDataFrame([(1, "w1 x5")], "query_id long, query string")
    out = systems.bm25_retriever(docs)(samples, 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan or "leftHint=(strategy=broadcast)" in plan
    assert {x["chunk"] for x in out.collect()} and out.where("chunk is null").count() == 0
