"""Reference formulas, edge fixtures and plug-ins of the retrieval-evaluation engine."""

import math
import random

import pytest
from pyspark.sql import functions as F

from calibrant.functions import text as t
from calibrant.operators import chunk, curves, fusion
from calibrant.operators import conformal as cf
from calibrant.operators import search as s
from calibrant.plans import systems
from calibrant.sources import datasets as ds
from calibrant.sources.index import Collections

ROWS = "split string, sample_id long, pos int, opt string, p double, correct boolean"


def rows_of(spark, samples: dict[int, tuple[list[float], set[int]]], split: str = "test"):
    return spark.createDataFrame([(split, i, k, chr(65 + k), p, k in right) for i, (ps, right) in samples.items() for k, p in enumerate(ps)], ROWS)


def one(df):
    return tuple(df.first())


def limits(spark, lac, aps):
    return spark.createDataFrame([(lac, aps)], "lac_threshold double, aps_threshold double")


@pytest.mark.parametrize("n,alpha", [(1, 0.1), (5, 0.1), (9, 0.7), (20, 0.05), (40, 0.1)])
def test_order_statistic_in_double(spark, n, alpha):
    r = random.Random(n)
    values = [round(r.random(), 3) for _ in range(n)]
    got = cf.thresholds(spark.createDataFrame([(v, v) for v in values], "lac double, aps double"), [alpha]).first()
    k = min(math.ceil((n + 1) * (1 - alpha)), n - 1)
    assert got["lac_threshold"] == sorted(values)[k] == got["aps_threshold"]


def test_no_calibration_rows(spark):
    assert one(cf.thresholds(spark.createDataFrame([], "lac double, aps double"), [0.1])) == (0.1, 0.5, 0.5)


def test_sets(spark):
    rows = rows_of(spark, {1: ([0.6, 0.3, 0.1], {0}), 2: ([0.4, 0.4, 0.2], {1})})
    aps = {x["sample_id"]: x["options"] for x in cf.sets(rows, limits(spark, 0.5, 0.75), "aps").collect()}
    assert aps == {1: "A", 2: "A"}  # the option that crosses stays out
    assert cf.sets(rows_of(spark, {1: ([0.9, 0.1], {0})}), limits(spark, 0.5, 0.5), "aps").first()["options"] == "A"
    lac = {x["sample_id"]: (x["options"], x["size"]) for x in cf.sets(rows, limits(spark, 0.45, 0.5), "lac").collect()}
    assert lac == {1: ("A", 1), 2: ("", 0)}


def test_scores_and_ties(spark):
    rows = rows_of(spark, {1: ([0.4, 0.4, 0.2], {1}), 2: ([0.5, 0.5], set())})
    got = {x["sample_id"]: (x["lac"], x["aps"]) for x in cf.scores(rows).collect()}
    assert got == {1: (0.6, 0.8), 2: (1.0, 1.0)}
    assert {x["sample_id"]: x["opt"] for x in cf.argmax(rows).collect()} == {1: "A", 2: "A"}


def test_skipped_rows_stay_in_denominators(spark):
    rows = rows_of(spark, {1: ([0.8, 0.2], {0})})
    samples = spark.createDataFrame([("test", 1), ("test", 2)], "split string, sample_id long")
    m = cf.metrics(rows, samples, limits(spark, 0.5, 0.9)).first()
    assert (m["total_samples"], m["accuracy"], m["lac_coverage"], m["lac_avg_set_size"]) == (2, 0.5, 0.5, 1.0)
    none = cf.metrics(rows.limit(0), samples.limit(0), limits(spark, 0.5, 0.9)).first()
    assert (none["total_samples"], none["accuracy"], none["lac_avg_set_size"]) == (0, 0.0, 0.0)


def test_curves(spark):
    r = random.Random(1)
    data = [(r.randrange(20) / 20, int(r.random() < 0.4)) for _ in range(200)]
    df = spark.createDataFrame(data, "p double, label int")
    pos, neg = [p for p, y in data if y], [p for p, y in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(curves.auroc(df).first()[0] - want) < 1e-9
    assert curves.auroc(spark.createDataFrame([(0.1, 1), (0.2, 1)], "p double, label int")).first()[0] is None
    assert 0 <= curves.aurac(df, ["label"]).first()[0] <= 1


def test_chunkers(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),) for n in (0, 451, 500, 501)], "text string")
    assert [x[0] for x in df.select(F.size(chunk.sliding(F.col("text")))).collect()] == [0, 2, 2, 2]
    with pytest.raises(ValueError):
        chunk.sliding(F.col("text"), 10, 10)
    assert df.select(F.size(chunk.sliding(F.col("text"), 10, 20))).first()[0] == 0
    with pytest.raises(ValueError):
        chunk.chunk(F.col("text"), "nothing")
    packed = spark.createDataFrame([("One two. Three four five! Six? Seven",)], "text string").select(chunk.sentence_pack(F.col("text"), 5)).first()[0]
    assert packed == ["One two Three four five", "Six Seven"]


def test_bm25_negative_idf_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a a"), (2, "a b"), (3, "a"), (4, "c")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "b b")], "query_id long, query string")
    got = s.Bm25(docs).search(asked, 4).collect()
    first = [x["doc_id"] for x in sorted(got, key=lambda x: (x["query_id"], x["rank"])) if x["query_id"] == 1]
    assert first[0] == 4 and len(first) == 4  # documents without the word stand above negative scores
    single = s.Bm25(docs).search(spark.createDataFrame([(2, "b")], "query_id long, query string"), 1).first()["score"]
    assert abs(2 * single - next(x["score"] for x in got if x["query_id"] == 2 and x["rank"] == 1)) < 1e-5


def test_fusion_edges(spark):
    zero = spark.createDataFrame([(1, "A", 0.0), (1, "B", 0.0)], "sample_id long, opt string, p double")
    assert {x["p"] for x in fusion.fuse(zero, zero, "max").collect()} == {0.5}
    with pytest.raises(ValueError):
        fusion.fuse(zero, zero, "unknown")
    none = fusion.fan_out(spark.createDataFrame([(1, []), (2, ["x"])], "sample_id long, docs array<string>"))
    assert sorted((x["sample_id"], x["context"]) for x in none.collect()) == [(1, ""), (1, ""), (1, ""), (2, "x"), (2, "x")]


def test_text(spark):
    df = spark.createDataFrame([("<head><title>x</title></head><p>a&amp;b</p><script>var t='</p>'</script> c",), (None,)], "h string")
    assert [x[0] for x in df.select(t.html_to_text(F.col("h"))).collect()] == ["a&b c", ""]
    said = spark.createDataFrame([("so Answer|B because",), ("C",), ("it is D.",), ("none",)], "r string")
    assert [x[0] for x in said.select(t.answer_letter(F.col("r"))).collect()] == ["B", "C", "D", "A"]
    out = spark.createDataFrame([("p one\n\ntwo\nthree\nlast",)], "r string").select(t.thoughts(F.col("r"), F.lit("p "), 2)).first()[0]
    assert out == ["one\nthree", "two", "", ""]
    assert spark.range(1).select(t.inject(F.lit("a</s>b"), "X", "</s>")).first()[0] == "a</s>X</s>b"
    assert spark.range(1).select(t.confidence_text(F.array(F.lit("A")), F.array(F.lit(0.25)))).first()[0] == "A: 0.2500"


def test_dataset_and_config(spark, tmp_path):
    good = tmp_path / "d.json"
    good.write_text('{"calibration": [{"id": 1, "question": "q", "options": ["A"], "correct_answer": ["A", "b"]}], "test": [{"id": "x", "question": "q", "options": ["A"], "correct_answer": "A"}]}')
    rows = {x["split"]: x for x in ds.read_dataset(spark, str(good)).collect()}
    assert rows["calibration"]["correct_answer"] == ["A", "b"] and rows["test"]["correct_answer"] == ["A"]
    bad = tmp_path / "b.json"
    bad.write_text('{"calibration": [{"id": 1, "options": ["A"], "correct_answer": "A"}], "test": []}')
    with pytest.raises(ValueError, match="question"):
        ds.read_dataset(spark, str(bad))
    bad.write_text('{"calibration": []}')
    with pytest.raises(ValueError, match="test"):
        ds.read_dataset(spark, str(bad))


def test_collections(spark, tmp_path):
    docs = spark.createDataFrame([(0, 1, "machine learning with neural networks"), (0, 2, "vision systems see"), (1, 3, "programming language Python"), (1, 4, "query language")], "db_index int, doc_id long, text string")
    index = Collections.build(docs, {0: "a", 1: "b"})
    index.save(str(tmp_path / "i"))
    index = Collections.load(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "programming language")], "query_id long, query string")
    for method in s.SEARCHES:
        assert index.search(asked, method, 1, 1).first()["doc_id"] == 3
    with pytest.raises(ValueError):
        index.search(asked, "other")
    with pytest.raises(ValueError):
        index.set_default(9)
    index.delete(0)
    assert index.default == 1 and index.stats().count() == 1


def test_registry():
    assert len(systems.list_systems()) == 17
    with pytest.raises(ValueError):
        systems.get_system("graphrag")
