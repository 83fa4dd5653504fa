"""What tasks hand on does not grow with ties, pairs or rare words: kernels against plain versions."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from calibrant.functions import text as t
from calibrant.operators import boundaries, options, tree
from calibrant.operators import search as s


def test_ties_are_not_handed_on():
    vectors = pa.RecordBatch.from_arrays([pa.array(range(999, -1, -1)), pa.array([[0.0, 0.0]] * 1000, pa.list_(pa.float64()))], names=["chunk_id", "c_vec"])
    shared = SimpleNamespace(value=(pa.array([7, 8]), np.array([[0.0, 0.0], [1.0, 0.0]]), None))
    out = pa.Table.from_batches(s._products(shared, 3, False)(iter([vectors, vectors.slice(0, 500)])))
    assert sorted(zip(out["query_id"].to_pylist(), out["chunk_id"].to_pylist())) == [(q, c) for q in (7, 8) for c in (0, 1, 2)]


def test_bm25_of_a_task_against_a_plain_version(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice("a b c d e f g".split()) for _ in range(r.randrange(9)))) for i in range(300)]
    queries = [(1, "a b b"), (2, "none"), (3, "g zz")]
    asked = spark.createDataFrame(queries, "query_id long, query string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    index = s.Bm25(df)
    got = [tuple(x) for x in index.search(asked, 7).select("query_id", "doc_id", "score").collect()]
    held, avgdl = Counter(w for _, x in docs for w in set(x.split())), sum(len(x.split()) for _, x in docs) / 300
    for q, text in queries:
        scores = []
        for i, x in docs:
            w = Counter(x.split())
            scores.append((-round(sum(np.log((300 - held[v] + 0.5) / (held[v] + 0.5)) * w[v] * 2.2 / (w[v] + 1.2 * (0.25 + 0.75 * len(x.split()) / avgdl)) for v in text.split()), 6) + 0.0, i))
        assert sorted((-x[2], x[1]) for x in got if x[0] == q) == sorted(scores)[:7]
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan  # words are counted in a document's row


def test_tfidf_counts_sequences_of_frequent_words_only(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choices(["aa", "bb", "cc", "dd"] + [f"rare{i}x{j}" for j in range(3)], k=12))) for i in range(80)]
    space = s.TfIdf(spark.createDataFrame(docs, "doc_id long, text string"), [], 2, 15)
    total, held = Counter(), Counter()
    for _, x in docs:
        w = x.split()
        grams = w + [" ".join(p) for p in zip(w, w[1:])]
        total.update(grams)
        held.update(set(grams))
    want = sorted(total, key=lambda g: (-total[g], g))[:15]
    got = {x["term"]: x["df"] for x in space.vocabulary.collect()}
    assert got == {g: held[g] for g in want}
    vectors = {}
    for x in space.vectors.collect():
        vectors.setdefault(x["doc_id"], {})[x["term"]] = x["w"]
    assert all(abs(sum(w * w for w in v.values()) - 1) < 1e-9 for v in vectors.values())
    best = {(x["query_id"], x["rank"]): (x["doc_id"], x["score"]) for x in space.search(spark.createDataFrame(docs[:5], "query_id long, query string"), 4).collect()}
    for q in range(5):
        plain = sorted((-round(sum(w * vectors[i].get(g, 0) for g, w in vectors[q].items()), 6), i) for i in vectors if set(vectors[i]) & set(vectors[q]))[:4]
        assert [best[q, k + 1] for k in range(len(plain))] == [(i, -x) for x, i in plain]


def test_nearest_centres_by_products(spark):
    r = np.random.default_rng(6)
    points = [("ab"[i % 2], f"{i:03}", [float(x) for x in r.integers(0, 3, 4) / 3]) for i in range(200)]
    nodes = spark.createDataFrame(points + [("none", "x", [0.0] * 4)], "sample_id string, node string, v array<double>")
    centres = [(s_, n, v) for s_, n, v in points if int(n) % 9 < 2]
    out = tree.assign(nodes, spark.createDataFrame(centres, "sample_id string, cluster string, c array<double>"))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(x["sample_id"], x["node"]): x["cluster"] for x in out.collect()}
    assert got == {(a, n): min((round(sum((x - y) ** 2 for x, y in zip(v, c)), 9), m) for b, m, c in centres if b == a)[1] for a, n, v in points}


def test_contexts_keep_line_breaks_where_only_spaces_are_trimmed(spark):
    df = spark.createDataFrame([([" a", "b \n", ""],)], "docs array<string>")
    assert tuple(df.select(t.thought_context(F.col("docs")), t.thought_context(F.col("docs"), " ")).first()) == ("a\nb", "a\nb \n\n")


def test_options_of_stored_outputs(spark):
    top = [[("A", 1.0), ("A", 2.0), ("B", float("nan")), ("x", 0.5)], [("r|A", 9.0), ("B", 1.0), ("A", None)], []]
    kind = "array<array<struct<token: string, logit: double>>>"
    rows = spark.createDataFrame([(1, ["Ans", "wer|A"], top, ["A", "B", "A"]), (2, [], [[("B", 1.0)]], ["A", "B"]), (3, None, None, ["A"])], f"sample_id long, tokens array<string>, logits {kind}, options array<string>")
    flat = rows.select("sample_id", F.posexplode("logits").alias("position", "top"))
    long = flat.select("sample_id", "position", F.explode("top").alias("x")).select("sample_id", "position", "x.*")
    asked = rows.select("sample_id", F.explode("options").alias("opt"))
    tell = lambda df: sorted(tuple(x) for x in df.select("sample_id", "opt", "p").collect())
    assert tell(options.best_of(flat, asked)) == tell(options.best_probabilities(long, asked))
    steps = rows.select("sample_id", F.posexplode("tokens").alias("position", "token"))
    out = options.answers_of(rows)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [x for x in tell(out) if x[0] != 2] == [x for x in tell(options.answer_probabilities(steps, long, asked)) if x[0] != 2]
    assert [round(x[2], 6) for x in tell(out) if x[0] == 2] == [0.0, 1.0]  # the position behind no token at all


def test_word_types_of_plain_and_other_tokens(spark):
    tokens = ["Word", '"Word."', "(e.g.)", "'", "...", "É!", "x)\"", "9.", "a-b", "\U0001d400z,", None]
    got = [tuple(x) for x in spark.createDataFrame([(x,) for x in tokens], "t string").select(boundaries.bare(F.col("t")), boundaries.word_type(F.col("t"))).collect()]
    assert got == [("Word", "word"), ('"Word.', "word"), ("(e.g.", "e.g"), ("", ""), ("...", ""), ("É!", "é"), ("x", "x"), ("9.", "9"), ("a-b", "a-b"), ("\U0001d400z,", "\U0001d400z"), (None, None)]


def test_an_index_search_hands_on_k_rows_a_query_not_a_row_a_posting():
    from calibrant.sources import postings

    r = random.Random(8)
    docs = {i: r.choices("abc", k=r.randrange(1, 9)) for i in range(-300, 300)}
    words = pa.RecordBatch.from_arrays([pa.array(list(docs)), pa.array(list(docs.values()), pa.list_(pa.string()))], names=["doc_id", "words"])
    lists = [x for b in postings._posted(100)(iter([words])) for x in b.to_pylist()]
    assert {(x["term"], x["block"], p["doc_id"], p["tf"], p["len"]) for x in lists for p in x["p"]} == {(w, i // 100, i, n, len(d)) for i, d in docs.items() for w, n in Counter(d).items()}
    assert len(lists) == 3 * 6
    rows = []
    for block in range(-3, 3):
        ids = [i for i in docs if i // 100 == block and i != 7]  # 7 is deleted
        rows.append({"block": block, "code": -1, "segment": 0, "docs": ids, "tfs": [len(docs[i]) for i in ids], "segments": [1] * len(ids), "nos": [1]})
        rows += [{"block": block, "code": "abc".index(x["term"]), "segment": 1, "docs": [p["doc_id"] for p in x["p"]], "tfs": [p["tf"] for p in x["p"]], "segments": None, "nos": None} for x in lists if x["block"] == block]
    kinds = pa.schema([("block", pa.int64()), ("code", pa.int32()), ("segment", pa.int32()), ("docs", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("segments", pa.list_(pa.int32())), ("nos", pa.list_(pa.int32()))])
    batch = pa.RecordBatch.from_pylist(rows, kinds)
    shared = SimpleNamespace(value=(2, np.array([0, 1, 2, 3]), np.array([0, 1, 1]), np.array([1.0, 2.0, -1.0])))  # query 0: a; query 1: b, less c

    def plain(weights):
        scores = []
        for i, d in docs.items():
            held = Counter(d)
            if i != 7:
                scores.append((-round(sum(w * held[t] * 2.2 / (held[t] + 1.2 * (0.25 + 0.75 * len(d) / 4)) for t, w in weights.items()), 6), i))
        return sorted(scores)[:5]

    for needy in (None, np.array([0, 1])):
        got = [x for b in postings._scored(shared, 5, 4.0, needy)(iter([batch.slice(0, 5), batch.slice(5)])) for x in b.to_pylist()]
        for no, weights in ((0, {"a": 1.0}), (1, {"b": 2.0, "c": -1.0})):
            assert sorted((-x["score"], x["doc_id"]) for x in got if x["no"] == no) == ([] if needy is None and no == 0 else plain(weights))


def test_packing_exchanges_nothing(spark):
    from calibrant.operators import chunk, packing

    r = random.Random(9)
    texts = [None, "", " . ! ", "one", *(". ".join(" ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 40))) for _ in range(30))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = packing.pack(df, ["doc_id"], "text", "sentence", None, 7, 10, 4)
    want = df.select("doc_id", F.posexplode(chunk.chunk(F.col("text"), "sentence", size=7)).alias("chunk_id", "chunk"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert "Exchange hash" not in packing.pack(df, ["doc_id"], "text", "sentence", None, 7, 10, 4)._jdf.queryExecution().executedPlan().toString()


def test_bm25_takes_frequencies_and_lengths_in_one_pass(spark):
    lists = [None, [], ["a", "a", "b"], ["b"], ["c", "a"]]
    words = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], names=["words"])
    rows = [x["n"] for b in s._frequencies(SimpleNamespace(value=pa.array(["a", "b", "z"])))(iter([words, words])) for x in b.to_pylist()]
    assert rows == [4, 4, 0, 10, 8, 12]
    docs = spark.createDataFrame([(1, "a a b"), (2, None), (3, ""), (4, "b c")], "doc_id long, text string")
    got = s.Bm25(docs).search(spark.createDataFrame([(1, "a"), (2, None)], "query_id long, query string"), 4).collect()
    score = round(np.log(3.5 / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / (5 / 3))), 6)
    assert sorted((x[0], -x[2], x[1]) for x in got) == [(1, -score, 1), *((1, 0, i) for i in (2, 3, 4)), *((2, 0, i) for i in (1, 2, 3, 4))]


def _against_sql(spark, folder, name: str, rows: list[tuple]) -> tuple[list, list]:
    """A query's rows over embeddings ``(vec_id, embedding, label)``, and those of its SQL."""
    import duckdb

    from calibrant.plans import index_queries, queries  # noqa: F401

    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet/*.parquet')")
    columns = "query_id, chunk_id, score, rank"
    want = duck.sql(f"select {columns} from ({queries.ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, queries.QUERIES[name](spark, str(folder)).select(*columns.split(", ")).collect())), sorted(want)


def test_stored_vectors_are_not_scaled_anew(spark, tmp_path):
    r = random.Random(5)
    got, want = _against_sql(spark, tmp_path, "cosine_with_zero_vectors", [(i, [r.gauss(0, 1) for _ in range(8)], i % 2) for i in range(120)])
    assert got == want and len(want) == 30


def test_every_vector_is_searched_in_its_group(spark, tmp_path):
    r = random.Random(6)
    got, want = _against_sql(spark, tmp_path, "cosine_topk_grouped", [(i, [r.gauss(0, 1) for _ in range(8)], i % 4 or None) for i in range(120)])
    assert got == want and {x[0] for x in got} == {i for i in range(120) if i % 4}


def test_pieces_of_a_group_meet(spark, monkeypatch):
    monkeypatch.setattr(s, "QUERY_ROWS", 100)
    monkeypatch.setattr(s, "MET_CHUNKS", 700)
    r = random.Random(7)
    entry = lambda: r.choice([-1.0, 0.0, 0.5, 2.0])  # noqa: E731  many ties
    odd = {3: None, 5: [None, 1.0, 1.0], 6: [float("nan"), 1.0, 1.0], 8: [1.0, 2.0], 9: [], 11: [2.0, 1.0]}
    rows = [(i, odd.get(i, [entry() for _ in range(3)]), "abc"[i % 40 > 30] if i % 50 else None) for i in range(2500)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g string").repartition(3)
    asked, held = df.select(F.col("id").alias("query_id"), F.col("v").alias("q_vec"), "g"), df.select(F.col("id").alias("chunk_id"), F.col("v").alias("c_vec"), "g")
    good = [(i, v, g) for i, v, g in rows if v and g and all(x is not None and x == x for x in v)]
    by: dict = {}
    for i, v, g in good:
        by.setdefault((g, len(v)), []).append((i, v))
    for lowest in (False, True):
        got: dict = {}
        for x in s.dense_topk(asked, held, 4, "g", lowest).collect():
            got.setdefault(x["query_id"], []).append((x["rank"], x["chunk_id"], x["score"]))
        assert set(got) == {i for i, _, _ in good}
        for members in by.values():
            ids, m = np.array([i for i, _ in members]), np.array([v for _, v in members])
            scores = m @ m.T
            for i, row in zip(ids, scores):
                best = np.lexsort((ids, row if lowest else -row))[:4]
                assert sorted(got[i]) == [(n + 1, ids[j], row[j]) for n, j in enumerate(best)]
