"""Similarity classes against exact Jaccard similarity of five-word shingles."""

import random

from calibrant.llm import op4_similar as near
from calibrant.llm.common import Scratch

SCHEMA = "doc_id long, text string, kt int, sig string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(r, words, times):
    w = list(words)
    for _ in range(times):
        w[r.randrange(len(w))] = "x%d" % r.randrange(10**6)
    return " ".join(w)


def test_classes(spark):
    r = random.Random(5)
    rows, pairs = [], []
    for i in range(80):
        words = ["w%d" % r.randrange(10**5) for _ in range(r.randrange(80, 400))]
        copy = edited(r, words, max(1, len(words) * (i % 8) // 160))
        rows += [(2 * i, " ".join(words), 1, None), (2 * i + 1, copy, 1, "b")]
        pairs.append((2 * i, similarity(" ".join(words), copy)))
    rows += [(900, None, None, None), (901, "", None, None), (902, "Two  words", None, None), (903, "two WORDS", None, None), (None, rows[0][1], None, None), (None, None, None, None), rows[3], (905, "long " * 200_000, None, None)]
    got = near.similar(spark.createDataFrame(rows, SCHEMA), Scratch(spark)).collect()
    assert len(got) == len(rows)
    of = {x["doc_id"]: x["component_id"] for x in got if x["doc_id"] is not None}
    assert sum(s >= 0.84 for _, s in pairs) > 10 and sum(s <= 0.7 for _, s in pairs) > 10
    for i, s in pairs:
        assert of[i] == i
        if s >= 0.84:
            assert of[i + 1] == i, s
        if s <= 0.74:
            assert of[i + 1] == i + 1, s
    assert (of[900], of[901], of[902], of[903], of[905]) == (900, 900, 902, 902, 905)
    assert sorted(x["component_id"] for x in got if x["doc_id"] is None) == [0, 900]
    assert near.similar(spark.createDataFrame([], SCHEMA), Scratch(spark)).count() == 0


def test_large_buckets_in_blocks(spark, monkeypatch):
    """A group of many near copies of one text, verified block by block, is one class."""
    r = random.Random(6)
    words = ["w%d" % r.randrange(10**5) for _ in range(300)]
    rows = [(i, edited(r, words, 2), None, None) for i in range(300)]
    got = near.similar(spark.createDataFrame(rows, SCHEMA), Scratch(spark)).collect()
    assert {x["component_id"] for x in got} == {0}
    monkeypatch.setattr(near, "BLOCK", 50)
    import numpy as np
    import pyarrow as pa

    sig = [near.sketch(near.min_hashes(t.encode())) for _, t, *_ in rows]
    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(20, 7)), pa.array(np.arange(s, s + 20)), pa.array(sig[s : s + 20], pa.binary())], names=["bucket", "kt", "bits"]) for s in range(0, 300, 20)]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for out in near.verify(near.limit(0.8))(iter(batches)):
        for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True):
            root[find(a)] = find(b)
    assert len({find(x) for x in range(300)}) == 1
