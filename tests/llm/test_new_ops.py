"""Operators 11 to 13 against plain versions, with their edge cases."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from calibrant.llm import op11_quality as op11
from calibrant.llm import op12_whitening as op12
from calibrant.llm import op13_merkle as op13
from calibrant.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(seed: int) -> list[str | None]:
    r = random.Random(seed)
    words = ["Wörd%d" % i for i in range(30)] + ["#", "a!", "<b>", "日本", "x\x1cy"]
    gaps = [" ", "  ", "\n", "\t", "\n\n", "\r\n", "\x0b", " "]  # the last: no space here
    texts: list = ["".join(r.choice(words) + r.choice(gaps) for _ in range(r.randrange(0, 120))) for _ in range(60)]
    texts += [None, "", " \n\t", "\n\n\n", "a", "a a a a a a", "b\nb\nb \nb", "one two three four five one two three four five", "x " * 9, "\nx", "x\n", "£#$ " * 400]
    return texts + [" ".join(f"w{i % 700}" for i in range(150_000))]


def test_counts_of_awkward_texts():
    texts = awkward(1)
    raw = [(t or "").encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    got = op11.measure(np.frombuffer(b"".join(raw), np.uint8), off)
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in (*op11.BASE, *op11.MORE)) == op11.plain_counts(t), t
    none = op11.measure(np.zeros(0, np.uint8), np.array([0, 0]))
    assert all(list(v) == [0] for v in none.values())


def test_binomial_tail_is_exact():
    for n, p, r in ((1, 0.1, 0), (50, 0.1, 3), (200, 0.02, 1), (400, 0.3, 100), (400, 0.3, 399), (5, 0.5, 5), (9000, 0.5, 4600)):
        f = Fraction(p)
        want = sum(math.comb(n, i) * f**i * (1 - f) ** (n - i) for i in range(r + 1))
        assert op11.tail(n, p, r) == pytest.approx(float(want), rel=1e-9)
    for n in (1, 20, 500):
        k = op11.allowance(n, 0.1, 0.01)
        assert (k < 0 or op11.tail(n, 0.1, k) <= 0.01) and op11.tail(n, 0.1, k + 1) > 0.01


def labelled(seed: int):
    """Two languages with plain and symbol-laden texts, one with too few labels."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(1500):
        lang = ("en", "fr", None)[0 if i % 3 else 1] if i > 20 else None
        bad = r.random() < 0.2
        w = ["".join(r.choices("abcdefgh", k=5)) for _ in range(r.randrange(12, 40))]
        rows.append((i, " ".join(x + ("##" if bad else "") for x in w), lang, "s", 1))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_cutoffs_are_certified_and_clean_texts_stay(spark):
    rows, labels = labelled(1)
    rows += [(5000, "too short", "en", "s", 1), (5001, None, "en", None, None), (5002, " ".join(["x"] * 20), "en", "s", 1), (None, rows[50][1], "fr", "s", 1), rows[60], rows[60], (5003, rows[100][1].replace("#", "") + " ## ## ## ## ##" * 40, "de", "s", 1)]
    docs = spark.createDataFrame([(*x, "mine", 3, "k") for x in rows], DOCS + ", stratum string, kept int, digest string").repartition(5)
    told = spark.createDataFrame([*labels, labels[3], (None, 1, 0), (7, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    verdicts, cutoffs = op11.quality_rules(docs, told, Scratch(spark))
    got = op11.digest(verdicts).collect()
    assert len(got) == len(rows)
    by_id = {x["doc_id"]: x for x in got}
    for i, t, *_ in rows:
        n = op11.plain_counts(t)
        x = by_id[i]
        assert tuple(x)[1:6] == n[:5] and x["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
    quality = {i: q for i, q, _ in labels}
    assert all(x["kept"] == bool(quality[x["doc_id"]]) for x in got if x["doc_id"] is not None and 21 <= x["doc_id"] < 1500)
    assert not by_id[5001]["kept"] and not by_id[5002]["kept"] and by_id[5003]["kept"] is (not by_id[5003]["base_failed"])
    found = {(x["stratum"], x["rule"]): x for x in cutoffs.collect()}
    assert found["=en", "symbols"]["cutoff"] and found["=fr", "symbols"]["cutoff"]
    assert all(x["cutoff"] is None for (stratum, _), x in found.items() if stratum == "")
    tests = len(found)
    for (stratum, _), x in found.items():
        rules = sum(s == stratum for s, _ in found)
        assert x["allowed"] == op11.allowance(x["good"], op11.RISK / rules, op11.DELTA / tests)
        assert x["cutoff"] is None or (x["allowed"] >= 0 and x["cutoff"] >= x["tuned"])


def test_a_rule_that_would_reject_good_texts_is_not_certified(spark):
    """Labels that say nothing: what the tuning half seems to show does not pass on the holdout beyond the allowance."""
    r = random.Random(3)
    rows = [(i, " ".join("".join(r.choices("abcdefgh", k=5)) + "!" * (r.random() < 0.3) for _ in range(30)), "en", "s", 1) for i in range(2000)]
    labels = [(i, int(r.random() < 0.5), 0) for i in range(2000)]
    verdicts, cutoffs = op11.quality_rules(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), Scratch(spark))
    kept = {x["doc_id"]: x["kept"] for x in verdicts.collect()}
    good = [i for i, q, _ in labels if q]
    assert sum(not kept[i] for i in good) <= op11.RISK * len(good)


def test_quality_of_empty_tables(spark):
    none, no_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op11.quality_rules(none, no_labels, Scratch(spark))[0].count() == 0
    one = op11.quality_rules(spark.createDataFrame([(1, "a b c d e f g h i j", "en", "s", 1)], DOCS), no_labels, Scratch(spark))[0].first()
    assert one["kept"] and one["rejected_by"] == ""


def by_numpy(vectors: list[list[float]]):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    d = x - s / n
    values, vecs = np.linalg.eigh(d.T @ d / n)
    return n, [sum(int(a) ** 2 for a in row) for row in (n * x - s)], values[::-1], vecs[:, ::-1], d


@pytest.mark.parametrize("dim", [3, 16])
def test_whitening(spark, dim):
    r = np.random.default_rng(dim)
    v = (r.normal(size=(400, dim)) @ r.normal(size=(dim, dim))).astype(np.float32)
    v[200:330] = v[7]
    rows = [(i, [float(c) for c in x], 1, 2.0) for i, x in enumerate(v)]
    junk = [(900, None, 1, 1.0), (901, [], 1, 1.0), (902, [float("nan")] * dim, 1, 1.0), (903, [None] * dim, 1, 1.0), (904, [float("inf")] * dim, 1, 1.0), (905, [1.0] * (dim + 1), 1, 1.0)]
    twice = [(None, rows[0][1], 1, 1.0), rows[3]]
    got = op12.whiten(spark.createDataFrame([*rows, *junk, *twice], "vec_id long, embedding array<float>, component int, n double").repartition(7)).collect()
    kept = [*rows, *twice]
    n, deviation, values, vecs, d = by_numpy([x[1] for x in kept])
    k = min(8, dim)
    assert len(got) == k * len(kept) and {x["n"] for x in got} == {n}
    assert max(x["identity_error"] for x in got) < 1e-9
    white = d @ vecs[:, :k] / np.sqrt(values[:k])
    have = sorted((x["component"], -1 if x["vec_id"] is None else x["vec_id"], x["deviation"], int(x["deviation_digits"]), round(abs(x["whitened"]), 6), round(x["explained"], 9)) for x in got)
    want = sorted((c + 1, -1 if kept[i][0] is None else kept[i][0], deviation[i], deviation[i], round(abs(white[i, c]), 6), round(values[c] / values.sum(), 9)) for i in range(len(kept)) for c in range(k))
    assert [x[:4] for x in have] == [x[:4] for x in want]
    assert np.allclose([x[4:] for x in have], [x[4:] for x in want], atol=2e-6)
    signs = {c: {np.sign(x["whitened"]) * np.sign(white[x["vec_id"], c]) for x in got if x["component"] == c + 1 and x["vec_id"] is not None and abs(x["whitened"]) > 1e-6} for c in range(k)}
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_degenerate_and_large_vectors(spark):
    make = lambda rows, kind="double": spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    assert op12.whiten(make([])).count() == 0 and op12.whiten(make([(1, None), (2, [])])).count() == 0
    one = op12.whiten(make([(1, [0.5, 0.25])])).collect()
    assert len(one) == 2 and all(x["whitened"] is None and x["explained"] is None and x["identity_error"] is None and x["deviation"] == 0 for x in one)
    flat = op12.whiten(make([(i, [float(i), 1.0, 2.0 * i]) for i in range(40)])).collect()
    assert {x["component"] for x in flat if x["whitened"] is not None} == {1} and flat[0]["identity_error"] < 1e-9
    big = op12.whiten(make([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e12, 0.5])])).collect()
    assert max(x["deviation"] for x in big) == 2**63 - 1 and max(int(x["deviation_digits"]) for x in big) > 2**64
    x = [[2**40, 3], [-(2**40) + 5, 4], [7, 1]]
    got = op12.whiten(make([(i, [a / 1024 for a in v]) for i, v in enumerate(x)])).collect()
    s = [sum(v[j] + 100_000 for v in x) for j in range(2)]
    assert {int(r["deviation_digits"]) for r in got} == {sum((3 * (a + 100_000) - s[j]) ** 2 for j, a in enumerate(v)) for v in x}
    assert op12.squares(np.array([[2**61, -(2**61) + 3]]), False) == [2**122 + (2**61 - 3) ** 2]


def records(seed: int) -> list[tuple]:
    r = random.Random(seed)
    out: list = []
    for i in range(r.randrange(60, 90)):
        lang = r.choice(["en"] * 6 + ["fr", "de", None, "", "é", "z", "日"])
        out.append((i, r.choice(["text %d" % (i % 9), None, "", "ü" * 40]), lang, r.choice(["s", None]), r.choice([5, None, 2**63 - 1])))
    out += [out[3], out[3], (None, "t", "en", "s", 4), (None, None, None, None, None), (7, "other", out[7][2], "s", 1), (1000, "only", "alone", "s", 4), (1001, "w " * 50_000, "en", "s", 100_000)]
    return out


@pytest.mark.parametrize(("seed", "fanout", "levels"), [(1, 2, 2), (2, 2, 10), (3, 3, 1)])
def test_manifest(spark, seed, fanout, levels):
    rows = records(seed)
    df = spark.createDataFrame([(*x, "k", 1) for x in rows], DOCS + ", tree string, idx int").repartition(4)
    got = op13.digest(op13.manifest(df, Scratch(spark), tampered=op13.every_seventh(), fanout=fanout, levels=levels)).collect()
    want = op13.plain([(i, s, lang, n, t) for i, t, lang, s, n in rows], fanout)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert any(not x[6] for x in want) and any(x[6] for x in want)


def test_manifest_of_little(spark):
    assert op13.manifest(spark.createDataFrame([], DOCS), Scratch(spark)).count() == 0
    one = op13.manifest(spark.createDataFrame([(1, None, "en", "s", 3)], DOCS), Scratch(spark), tampered=op13.F.lit(True)).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof"] == "" and not one["verified"]
    same = op13.manifest(spark.createDataFrame([(1, "a", "en", "s", 3)] * 300, DOCS), Scratch(spark), levels=3).collect()
    assert len({x["proof"] for x in same}) > 1 and all(x["verified"] for x in same)


def test_a_proof_of_another_length_raises():
    with pytest.raises(ValueError, match="another length"):
        op13.fold("a" * 64, "b" * 128, 2, (0, 2), (0, 1))
