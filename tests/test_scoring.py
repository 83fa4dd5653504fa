"""Token logits, learnt sentence boundaries, packing by pieces and white space at the ends of texts."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibrant.functions import text as t
from calibrant.operators import boundaries, chunk, options, packing
from calibrant.sources.tables import Workspace

STEPS, LOGITS, OPTIONS = "sample_id int, position int, token string", "sample_id int, position int, token string, logit double", "sample_id int, opt string"


def packed(parts: list[str], size: int, glue: str) -> list[str]:
    """The greedy loop as it reads."""
    out, now, n = [], [], 0
    for p in parts:
        k = len(p.split())
        if now and n + k > size:
            out.append(glue.join(now))
            now, n = [], 0
        now.append(p)
        n += k
    return out + [glue.join(now)] * bool(now)


@pytest.mark.parametrize("size,piece", [(1, 1), (5, 3), (7, 16), (40, 5)])
def test_packing_by_pieces(spark, size, piece):
    r = random.Random(size)
    texts = [None, "", " . ! ", "one two three", *(". ".join(" ".join("w" * r.randint(1, 3) for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 60))) for _ in range(8))]
    ids = [1, 1, None, 2, None, *range(10, 17)]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id int, body string")
    got = packing.pack(df, ["doc_id"], "body", "sentence", Workspace(spark), size, 4, piece).collect()
    want = []
    for i, x in zip(ids, texts):
        parts = [p.strip() for p in re.split("[.!?]+", x or "") if p.strip()]
        want += [(i, n, c) for n, c in enumerate(packed(parts, size, " "))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_packing_tables_equal_the_walk():
    r = np.random.default_rng(3)
    for _ in range(200):
        words, size = r.integers(1, 9, r.integers(1, 30)), int(r.integers(1, 12))
        out, more = packing.through(words, size)
        for carry in range(size + 1):
            n, c = carry, 0
            for k in words:
                if n and n + k > size:
                    n, c = 0, c + 1
                n += k
            assert (out[carry], more[carry]) == (min(n, size), c)
            assert packing.numbers(words, size, carry, 4)[-1] == 4 + c


def test_packing_of_a_million_sentences(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.concat(F.lit("word "), i.cast("string"), F.when(i % 7 == 0, " more words").otherwise(""))), ". ").alias("text"))
    got = packing.pack(df, ["doc_id"], "text", "sentence", Workspace(spark), 500).orderBy("chunk_id").collect()
    want = packed([f"word {i}" + " more words" * (i % 7 == 0) for i in range(1, 1_000_001)], 500, " ")
    assert [x["chunk"] for x in got] == want


def test_packing_refuses(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    with pytest.raises(ValueError, match="method"):
        packing.pack(df, ["doc_id"], "text", "nothing", Workspace(spark))
    assert packing.pack(df, ["doc_id"], "text", "paragraph", Workspace(spark), 5, 1, 2).count() == 0


def test_strip_takes_all_white_space(spark):
    texts = ["\n\ta b  \n", "\x1cx\x85", " \r\n ", "", None]
    got = [x[0] for x in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(t.strip(F.col("x"))).collect()]
    assert got == [x.strip() if x is not None else None for x in texts]
    parts = spark.createDataFrame([("One two.\nThree four. Five",)], "x string").select(chunk.sentence_pack(F.col("x"), 9)).first()[0]
    assert parts == ["One two Three four Five"]


def test_answer_behind_a_marker_that_crosses_tokens(spark):
    said = {1: ["x Ans", "wer", "|", "", "B"], 2: ["Answer|A, no: Ans", "wer|", "C"], 3: ["an", "Answer|D."], 4: ["no", "marker"], 5: ["Answer|"], 6: [None, "Answer", "|B"]}
    steps = spark.createDataFrame([(s, i, x) for s, v in said.items() for i, x in enumerate(v)], STEPS)
    got = {x["sample_id"]: (x["position"], x["head"]) for x in options.answer_positions(steps).collect()}
    assert got == {1: (4, ""), 2: (2, ""), 3: (1, "Answer|"), 4: (2, ""), 5: (1, ""), 6: (2, "|")}


def test_answer_probabilities(spark):
    steps = spark.createDataFrame([(1, 0, "Answer|"), (1, 1, "A"), (2, 0, "Answer"), (2, 1, "|B"), (3, 0, "Answer|"), (3, 1, "A")], STEPS)
    logits = spark.createDataFrame([(1, 1, "A", 2.0), (1, 1, "A", 1.0), (1, 1, "B", 1.0), (1, 1, "the", 90.0), (1, 0, "B", 99.0), (2, 1, "|A", 0.5), (2, 1, "|B", 1.5), (2, 1, "A", 50.0), (3, 1, "A", None), (3, 1, "B", math.nan), (3, 1, "C", -math.inf)], LOGITS)
    asked = spark.createDataFrame([(i, o) for i in (1, 2, 3, 4) for o in "AB"] + [(1, "A")], OPTIONS)
    got = {(x["sample_id"], x["opt"]): x["p"] for x in options.answer_probabilities(steps, logits, asked).collect()}
    one = round(1 / (1 + math.exp(-1)), 9)
    assert got == {(1, "A"): one, (1, "B"): round(1 - one, 9), (2, "A"): round(1 - one, 9), (2, "B"): one, (3, "A"): 0.5, (3, "B"): 0.5, (4, "A"): 0.5, (4, "B"): 0.5}


def test_best_over_positions(spark):
    r = random.Random(5)
    rows = [(s, p, x, r.uniform(-3, 3)) for s in range(4) for p in range(6) for x in ("A", "B", "the", "of")]
    asked = spark.createDataFrame([(s, o) for s in range(5) for o in "ABC"], OPTIONS)
    got = {(x["sample_id"], x["opt"]): x["p"] for x in options.best_probabilities(spark.createDataFrame(rows, LOGITS), asked).collect()}
    for s in range(4):
        best = {o: max((math.exp(v) / sum(math.exp(w) for a, b, _, w in rows if (a, b) == (s, p)) for a, p, x, v in rows if (a, x) == (s, o)), default=0.0) for o in "ABC"}
        assert all(got[s, o] == pytest.approx(best[o] / sum(best.values()), abs=1e-8) for o in "ABC")
    assert all(got[4, o] == pytest.approx(1 / 3, abs=1e-8) for o in "ABC")


def test_sentence_boundaries(spark):
    cases = {
        "Mr. Tolan paid 3.5 coins. He left!": ["Mr. Tolan paid 3.5 coins.", "He left!"],
        "See e.g. the second part of it. Then J. Tolan came here.": ["See e.g. the second part of it.", "Then J. Tolan came here."],
        "It was on the 3. of May that year. \"Was it?\" He asked that.": ["It was on the 3. of May that year.", '"Was it?"', "He asked that."],
        "Well... perhaps it was so. But... Then nobody knew.": ["Well... perhaps it was so.", "But...", "Then nobody knew."],
        "The coins etc. were paid in full. The end came soon": ["The coins etc. were paid in full.", "The end came soon"],
        "They paid coins etc. Then they left the house.": ["They paid coins etc.", "Then they left the house."],
        "no mark at all": ["no mark at all"],
    }
    corpus = [(x,) for x in ["Mr. Tolan came and paid. Mr. Varga left the house.", "Coins, stones etc. were there; then, etc. they went."] * 20 + ["then the house was paid and they went and left it for a very long time in the end"] * 40]
    learnt = spark.createDataFrame(corpus, "text string")
    assert {x["type"] for x in boundaries.abbreviations(boundaries.vocabulary(learnt)).collect()} == {"mr", "etc"}
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(cases)] + [(90, None), (91, "  "), (92, "a. b."), (0, "Twice the same id.")], "doc_id int, text string")
    got = {}
    for x in boundaries.sentences(texts, ["doc_id"], "text", Workspace(spark), least=3, corpus=learnt).orderBy("chunk_id").collect():
        got.setdefault(x["doc_id"], []).append(x["chunk"])
    assert sorted(got[0]) == sorted([*list(cases.values())[0], "Twice the same id."])
    assert {i: got[i] for i in range(1, len(cases))} == dict(list(enumerate(cases.values()))[1:])
    assert set(got) == set(range(len(cases)))  # "a." and "b." are two sentences, too short to keep


def test_sentences_keep_the_limits(spark):
    texts = spark.createDataFrame([(1, "Short one. " + "x" * 1500 + ". A sentence of enough length.")], "doc_id int, text string")
    got = [x["chunk"] for x in boundaries.sentences(texts, ["doc_id"], "text", Workspace(spark)).orderBy("chunk_id").collect()]
    assert got == ["x" * 1000, "A sentence of enough length."]
