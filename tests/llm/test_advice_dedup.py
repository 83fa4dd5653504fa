"""Cases of the review of round 1 for the pipeline's near-duplicate and suffix stages."""

import random

import corpus_pipeline
from calibrant.llm import op4_similar as near
from calibrant.llm.common import Scratch

TEXTS = "doc_id long, text string"


def pair_at(r, both, either):
    """Two texts of 5-word shingles with ``both`` in common out of ``either``."""
    word = lambda n: ["w%d" % r.randrange(10**9) for _ in range(n)]
    shared, tail = word(both + 4), (either - both) // 2
    return " ".join(shared + word(tail)), " ".join(shared + word(tail))


def test_similarity_at_the_limit(spark):
    r = random.Random(21)
    cases = [(hundredths, *pair_at(r, 2 * hundredths, 200)) for hundredths in (77, 79, 80, 81) for _ in range(15)]
    rows = [(2 * i + k, text) for i, (_, *texts) in enumerate(cases) for k, text in enumerate(texts)]
    of = {x["doc_id"]: x["component_id"] for x in near.similar(spark.createDataFrame(rows, TEXTS), Scratch(spark)).collect()}
    for i, (hundredths, *_) in enumerate(cases):
        assert of[2 * i + 1] == 2 * i + (hundredths < 80), hundredths


def test_large_bucket_keeps_every_member(spark, monkeypatch):
    """A chain in which each text is near the next one only: all links of a bucket are found, though it is dealt into blocks."""
    monkeypatch.setattr(near, "BLOCK", 10)
    members = spark.createDataFrame([(7, k) for k in range(60)] + [(8, 1), (8, 2)], "bucket long, kt long")
    rows = near.split_large(members).collect()
    met = {}
    for x in rows:
        met.setdefault(x["bucket"], set()).add(x["kt"])
    assert met[8] == {1, 2} and max(map(len, met.values())) < 45
    assert all(any({a, b} <= group for group in met.values()) for a in range(60) for b in range(a))


def test_passage_of_51_short_words(spark):
    r = random.Random(23)
    text = lambda n, k: " ".join("".join(r.choices("abcdefghijklm", k=k)) for _ in range(n))
    short, long, fifty = text(51, 3), text(51, 8), text(49, 8)
    rows = [(i, " ".join([text(60, 6), passage, text(60, 6)]), "en", "s", 1) for i, passage in enumerate([short, short, long, long, fifty, fifty])]
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.suffix_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}
    for i, passage in enumerate([short, short, long, long, fifty, fifty]):
        assert (passage in got[i]) == (i > 3), i
