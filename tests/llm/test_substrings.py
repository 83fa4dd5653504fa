"""Operators 5 and 7 against their definitions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from calibrant.llm import op5_suffix as op5
from calibrant.llm import op7_substring as op7
from calibrant.llm.common import Scratch

SCHEMA = "doc_id long, text string, kd string, spans string, extra int"


def corpus(seed: int, vocab: int = 400) -> list[tuple]:
    r = random.Random(seed)
    word = [("w%d" % i) + "é" * (i % 3) for i in range(vocab)]
    passages = [" ".join(r.choices(word, k=k)) for k in (13, 14, 20, 40, 90, 12)]
    docs: list[str | None] = []
    for _ in range(60):
        parts = [" ".join(r.choices(word, k=r.randrange(0, 60))) for _ in range(3)]
        parts.insert(r.randrange(3), r.choice(passages))
        docs.append(r.choice([" ", "\n", " \t "]).join(parts))
    docs += [docs[0], docs[0], docs[1].replace("w1", "w2"), None, "", " ", "ha " * 40, "ha " * 200, "a b " * 90, "a b " * 60 + "x", "z" * 1200, passages[4], docs[3][5:]]
    rows = [(i * 3, t, "x", "y", 1) for i, t in enumerate(docs)]
    return rows + [rows[5], rows[5], (None, docs[4], None, None, None), (None, None, None, None, None), (9, docs[20], None, None, 2)]


def digests(out):
    columns = [c for c in out.columns if c != "text"]
    return sorted(repr(tuple(x)) for x in out.select(*columns).collect())


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("width", [100, 400])
def test_suffix_dedup(spark, seed, width):
    rows = corpus(seed)
    want = sorted(map(repr, op5.brute_force([x[:2] for x in rows], width)))
    df = spark.createDataFrame(rows, SCHEMA)
    assert digests(op5.digest(op5.suffix_dedup(df, Scratch(spark), width))) == want
    # long documents in pieces, buckets too large to gather
    assert digests(op5.digest(op5.suffix_dedup(df, Scratch(spark), width, bucket_bytes=1, slice_bytes=90))) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup(spark, seed):
    rows = corpus(seed, 400 if seed < 3 else 6)
    random.Random(seed).shuffle(rows)
    want = sorted(map(repr, op7.brute_force([x[:2] for x in rows])))
    df = spark.createDataFrame(rows, SCHEMA)
    assert digests(op7.digest(op7.substring_dedup(df, Scratch(spark)))) == want
    assert digests(op7.digest(op7.substring_dedup(df, Scratch(spark), bucket_rows=1, slice_bytes=150))) == want


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert op5.suffix_dedup(none, Scratch(spark)).count() == 0
    assert op7.substring_dedup(none, Scratch(spark)).count() == 0


def test_whole_characters(spark):
    r = random.Random(4)
    shared = "".join(r.choices("éèüßa", k=90))
    # the bytes before the shared passage end alike but belong to different characters
    rows = [(1, "ĩ" + shared + "xy", "", "", 1), (2, "é" + shared + "zw", "", "", 1)]
    out = op5.suffix_dedup(spark.createDataFrame(rows, SCHEMA), Scratch(spark), 60, characters=True).collect()
    assert sorted((x["doc_id"], x["kept"].decode()) for x in out) == [(1, "xy"), (2, "zw")]
    split = op5.suffix_dedup(spark.createDataFrame(rows, SCHEMA), Scratch(spark), 60).collect()
    assert {x["kept"] for x in split} == {b"\xc4xy", b"\xc3zw"}


@pytest.mark.parametrize("width", [8, 12, 20, 33])
def test_bucket_pointers(width):
    """Suffixes share a pointer if and only if they share a prefix of that width, and pointers follow the order of the suffixes."""
    data = np.array(random.Random(width).choices(b"ab", k=1500), np.uint8)
    pointer, text = op5.bucket_pointers(data, width), data.tobytes()
    of: dict[bytes, set] = {}
    for i in range(len(text) - width + 1):
        of.setdefault(text[i : i + width], set()).add(int(pointer[i]))
    ends = [next(iter(of[k])) for k in sorted(of)]
    assert all(len(x) == 1 for x in of.values()) and ends == sorted(set(ends))


def test_words_that_a_polynomial_confuses(spark):
    """A 1,024-letter word in Thue-Morse order and its complement are different words."""
    turn = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = turn.translate(str.maketrans("ab", "ba"))
    rows = [(i, " ".join([*("w%d" % k for k in range(12)), x]), "", "", 1) for i, x in enumerate((turn, other, turn))]
    got = op7.digest(op7.substring_dedup(spark.createDataFrame(rows, SCHEMA), Scratch(spark))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, op7.brute_force([x[:2] for x in rows])))
    bytes_ = [(i, x, "", "", 1) for i, x in enumerate((turn, other, turn[100:800]))]
    cut = op5.digest(op5.suffix_dedup(spark.createDataFrame(bytes_, SCHEMA), Scratch(spark)))
    assert digests(cut) == sorted(map(repr, op5.brute_force([x[:2] for x in bytes_])))


@pytest.mark.parametrize("names", [1, 2])
def test_names_route_and_texts_decide(spark, monkeypatch, names):
    """All anchors share one name, or two: buckets are larger, results the same."""
    rows = corpus(1)[:30]
    df = spark.createDataFrame(rows, SCHEMA)
    real = op7.word_runs

    def clashing(width, names_only, limit):
        runs = real(width, names_only, limit)

        def run(batches):
            for batch in runs(batches):
                at = batch.schema.names.index("key")
                key = pa.array(batch.column(at).to_numpy() % names)
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], key, *batch.columns[at + 1 :]], names=batch.schema.names)

        return run

    monkeypatch.setattr(op7, "word_runs", clashing)
    got = digests(op7.digest(op7.substring_dedup(df, Scratch(spark))))
    assert got == sorted(map(repr, op7.brute_force([x[:2] for x in rows])))


def test_wide_windows_use_more_rounds(spark):
    assert op7.anchor_kinds(13) == [(1, 3), (1, 2), (0, 2), (0, 1)] and op7.anchor_kinds(50)[0] == (4, 3) and op7.anchor_kinds(1) == [(0, 1)]
    rows = corpus(3)
    for width in (1, 40):
        got = digests(op7.digest(op7.substring_dedup(spark.createDataFrame(rows, SCHEMA), Scratch(spark), width)))
        assert got == sorted(map(repr, op7.brute_force([x[:2] for x in rows], width)))


def test_long_documents_in_pieces(spark):
    """Two texts of 1.5 MB that share a passage far from each other's slice limits."""
    r = random.Random(8)
    word = ["w%d" % i for i in range(5000)]
    passage = " ".join(r.choices(word, k=3000))
    rows = [(i, " ".join(r.choices(word, k=90_000 + 70_000 * i)) + " " + passage + " " + " ".join(r.choices(word, k=150_000)), "", "", 1) for i in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    cut = {x["doc_id"]: x for x in op7.substring_dedup(df, Scratch(spark)).collect()}
    assert cut[0]["n_removed"] == 0 and 3000 <= cut[1]["n_removed"] < 3100
    assert len(passage) <= next(x["n_removed"] for x in op5.suffix_dedup(df, Scratch(spark)).collect()) < len(passage) + 50
