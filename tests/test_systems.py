"""Systems, model interfaces, sources and sinks on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from calibrant.functions import prompts as pr
from calibrant.functions import text as t
from calibrant.operators import conformal as cf
from calibrant.operators import search as s
from calibrant.plans import models, systems
from calibrant.sources import datasets as ds
from calibrant.sources.index import Collections
from calibrant.streaming import running_coverage

SAMPLES = "sample_id int, question string, options array<string>, query_time string, context string"


@pytest.fixture(scope="module")
def samples(spark):
    long = "red fish swims\n- blue bird flies over the red house near the sea every day"
    return spark.createDataFrame([(1, "which fish is it of all the fish that swim here", ["red fish", "blue bird"], "now", long), (2, "short", ["x", "y", "z"], None, None)], SAMPLES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "the red fish swims"), (2, "a blue bird"), (3, "which fish"), (4, "other")], "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(systems.REGISTRY))
def test_every_system_answers_every_sample(spark, samples, docs, name):
    out = systems.get_system(name, retriever=systems.bm25_retriever(docs), model="llama").answer(samples).collect()
    assert sorted(x["sample_id"] for x in out) == [1, 2]
    for x in out:
        assert [p["opt"] for p in x["probs"]] == x["options"] and abs(sum(p["p"] for p in x["probs"]) - 1) < 1e-6
        assert x["predicted_answer"] in x["options"] and x["technique"]
    by = {x["sample_id"]: x for x in out}
    if name in ("simplerag", "hyderag", "fusionrag", "raptorrag", "fidrag", "corag", "ratrag"):
        assert by[1]["predicted_answer"] == "red fish" and by[1]["context"]
    if name.startswith("raptor"):
        assert by[1]["raptor_used"] and not by[2]["raptor_used"] and "RAPTOR Analysis: " in by[1]["context"]
    if name.startswith("fid"):
        assert json.loads(by[2]["prompt"])["prefix"].startswith("Answer the multiple choice") and by[1]["passages"]
    if name in ("selfllm", "selfrag"):
        assert by[1]["reflection"]["relevance"] in ("relevant", "irrelevant")
    if name == "selfrag":
        assert by[1]["retrieve"] and not by[2]["retrieve"] and by[2]["docs"] == [] and by[2]["composite_score"] is not None
    if name == "corag":
        assert len(by[1]["subqueries"]) == len(by[1]["subanswers"]) == 3 and "Intermediate query 3" in by[1]["prompt"]


def test_side_outputs(spark, samples):
    queries = {x["sample_id"]: x["queries"] for x in systems.FusionLlm().fan_out(samples).collect()}
    assert queries[2] == ["short"] and queries[1][1:] == ["of all the fish that swim here", "fish is it of all the fish that swim here", "that swim here".replace("that", "fish that")]
    thoughts = systems.RatLlm(generator=lambda: lambda p: ["one\ntwo\nthree\nfour\nAnswer|A"] * len(p)).thoughts(samples).first()["thoughts"]
    assert thoughts == ["one\nfour", "two", "three", "", "", ""]
    with pytest.raises(ValueError):
        systems.get_system("simplellm", technique="graph")
    systems.register("Mine", systems.SimpleLlm)
    assert "mine" in systems.list_systems()
    del systems.REGISTRY["mine"]


def test_methods_ask_again_with_a_confidence(spark, samples):
    for method in ("aware", "attack", "defense"):
        out = systems.SimpleLlm(method=method, model="llama", scorer=systems.model_scorer(models.hash_scorer)).answer(samples).first()
        assert "Your previous confidence for each answer is " in out["prompt"]
    with pytest.raises(ValueError):
        pr.with_confidence(F.lit("x"), F.array(F.lit("A")), F.array(F.lit(1.0)), "unknown", "</s>")


def test_a_failing_row_keeps_its_error_and_no_other(spark, samples):
    def fragile():
        def model(prompts, options, contexts):
            if any("short" in p for p in prompts):
                raise RuntimeError("too short")
            return [[1.0] * len(o) for o in options]

        return model

    out = {x["sample_id"]: x for x in systems.SimpleLlm(scorer=systems.model_scorer(fragile, 10)).answer(samples.coalesce(1)).collect()}
    assert out[1]["logits_error"] is None and out[2]["logits_error"] == "RuntimeError: too short"
    assert [p["p"] for p in out[2]["probs"]] == [round(1 / 3, 9)] * 3
    told = spark.createDataFrame([(1, [0.0, 5.0])], "sample_id int, logits array<double>")
    assert systems.SimpleLlm(scorer=models.from_table(told)).answer(samples.where("sample_id = 1")).first()["predicted_answer"] == "blue bird"


def test_retrievers(spark, samples, docs):
    asked = spark.createDataFrame([(1, "the red fish"), (2, "a blue bird")], "query_id int, query string")
    found = {(x["query_id"], x["rank"]): x["chunk"] for x in systems.embedding_retriever(docs, models.hashed_embedder())(asked, 2).collect()}
    assert found[1, 1] == "the red fish swims" and found[2, 1] == "a blue bird"
    own = spark.createDataFrame([(1, "a blue bird"), (2, "the red fish")], "sample_id int, text string")
    grouped = {x["query_id"]: x["chunk"] for x in systems.grouped_retriever(own, models.hashed_embedder())(asked, 3).collect()}
    assert grouped == {1: "a blue bird", 2: "the red fish"}  # only a sample's own documents
    both = systems.two_lists(systems.embedding_retriever(docs, models.hashed_embedder()), None, asked, 2).first()
    assert len(both["semantic"]) == 2 and both["other"] == []
    assert systems.two_lists(systems.fixed_retriever, systems.fixed_retriever, asked, 2, 1).first()["other"] == [systems.FIXED_DOCS[0]]
    assert models.embedding_model("tfidf") == models.embedding_model("openai") == ("tfidf", None)
    assert models.embedding_model("sentence_transformers")[1] == models.DEFAULT_EMBEDDING and models.embedding_model("my-model") == ("sentence_transformers", "my-model")


def test_strict_labels(spark):
    good, bad = (spark.createDataFrame([row], "o array<string>, l array<string>") for row in ((["A", "B"], ["b"]), (["A", "long"], ["A"])))
    assert good.select(t.label_match_strict(F.col("o"), F.col("l"))).first()[0] == [0, 1]
    with pytest.raises(Exception, match="single characters"):
        bad.select(t.label_match_strict(F.col("o"), F.col("l"))).collect()


def test_sinks_and_runner(spark, tmp_path):
    rows = spark.createDataFrame([("test", 1), ("calibration", 2)], "split string, sample_id int")
    metrics = spark.createDataFrame([(2, 0.5)], "total_samples int, accuracy double")
    ran = ds.run_pending(spark, {"a": lambda path: ds.write_results(rows, metrics, path), "b": lambda path: None}, f"file://{tmp_path}")
    assert ran == ["a", "b"] and json.loads((tmp_path / "a" / "evaluation_metrics.json").read_text()) == {"total_samples": 2, "accuracy": 0.5}
    assert ds.run_pending(spark, {"a": lambda path: None}, f"file://{tmp_path}") == []
    assert ds.read_rows(spark, f"{tmp_path}/a/test_results", "sample_id int").collect()[0][0] == 1
    assert [x["text"] for x in ds.report(metrics).orderBy("line").collect()] == ["Total Samples: 2", "Accuracy: 0.5000"]
    assert ds.load_config("system: {name: simplerag}\ndataset: d")["system"]["name"] == "simplerag"
    for bad in ("dataset: d", "system: {name: x}", "system: {}\ndataset: d"):
        with pytest.raises(ValueError):
            ds.load_config(bad)


def test_knowledge(spark):
    assert sum(map(len, ds.LOOKUPS.values())) == 38
    table = spark.createDataFrame([(1, "d1", "x"), (1, "d2", "y"), (2, "d1", "z")], "rank int, date string, song string")
    known = ds.Knowledge({"music_get_billboard_rank_date": table})
    assert known.call("music", "get_billboard_rank_date", rank=1).count() == 2
    assert known.call("music", "get_billboard_rank_date", rank=1, date="d2").first()["song"] == "y"
    for domain, name, values in (("music", "nothing", {}), ("music", "get_billboard_rank_date", {"date": "d1"}), ("music", "get_billboard_rank_date", {"rank": 1, "song": "x"}), ("movie", "get_movie_info", {"query": "x"})):
        with pytest.raises(ValueError):
            known.call(domain, name, **values)


def test_collections_move_grow_and_describe(spark, tmp_path):
    docs = spark.createDataFrame([(0, 1, "neural networks learn"), (1, 2, "birds fly high")], "db_index int, doc_id long, text string")
    index = Collections.build(docs, {0: "a", 1: "b"})
    index.save(str(tmp_path / "i"))
    moved = Collections.load(spark, str(tmp_path / "i"), str(tmp_path / "j"))
    moved.append(spark.createDataFrame([(1, 3, "fish swim")], "db_index int, doc_id long, text string"))
    assert [(x["point_id"], x["doc_id"]) for x in moved.scroll(1).collect()] == [(0, 2), (1, 3)]
    about = {x["db_name"]: x for x in moved.details().collect()}
    assert (about["b"]["points_count"], about["a"]["distance_metric"], about["a"]["vector_size"]) == (2, "Cosine", 5)
    with pytest.raises(FileNotFoundError):
        Collections.load(spark, str(tmp_path / "none"))


def test_running_sums_equal_a_global_window(spark):
    from calibrant.operators.running import running

    rows = [(i, (i * 37 % 101) / 100, i % 3, "ab"[i % 2]) for i in range(400)] + [(900, 0.0, 1, "a"), (901, 1.0, 2, "b")]
    df = spark.createDataFrame(rows, "id int, p double, x int, g string")
    for descending in (False, True):
        got = {r["id"]: r["upto"] for r in running(df, "p", {"upto": F.col("x")}, by=("g",), ties=("id",), descending=descending).collect()}
        for g in "ab":
            total = 0
            for i, _, x, _ in sorted((r for r in rows if r[3] == g), key=lambda r: (-r[1] if descending else r[1], r[0])):
                total += x
                assert got[i] == total


def test_query_sets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "QUERY_ROWS", 7)
    q = spark.createDataFrame([(i, [float(i % 5), 1.0], f"w{i % 4} common") for i in range(30)], "query_id int, q_vec array<double>, query string")
    c = spark.createDataFrame([(i, [float(i % 9), -1.0], f"text w{i % 3} Common {i}") for i in range(40)], "chunk_id int, c_vec array<double>, chunk string")
    dense, matched = (df.collect() for df in (s.dense_topk(q.select("query_id", "q_vec"), c.select("chunk_id", "c_vec"), 3), s.match_topk(q.select("query_id", "query"), c.select("chunk_id", "chunk"), 3)))
    assert len(dense) == len(matched) == 90
    for x in dense:
        best = sorted((-(x["query_id"] % 5 * (k % 9) - 1.0), k) for k in range(40))[x["rank"] - 1]
        assert (x["chunk_id"], x["score"]) == (best[1], -best[0])
    for x in matched:
        best = sorted((-(1 + (x["query_id"] % 4 == k % 3)) / 2, k) for k in range(40))[x["rank"] - 1]
        assert (x["chunk_id"], x["score"]) == (best[1], -best[0])


def test_streaming_coverage(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", 0.9), ("2024-01-01 00:20:00", 0.1), ("2024-01-01 02:00:00", 0.9)], "ts string, p_correct double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = running_coverage(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 0.5)
    run = stream.writeStream.outputMode("complete").format("memory").queryName("coverage").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((x["n"], x["covered"]) for x in spark.table("coverage").collect()) == [(1, 1), (2, 1)]


def test_custom_metric_and_combined(spark):
    row = spark.createDataFrame([(0.5, 0.8, 0.9, 1.0, 2.0)], "accuracy double, lac_coverage double, aps_coverage double, lac_avg_set_size double, aps_avg_set_size double")
    assert tuple(cf.combined(row).first()) == (0.5, 0.85, 1.5)
