"""Large values, long words and texts, empty tables, hot copies; models against plain versions."""

import math
import random
import tempfile
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from calibrant.llm import op1_topk as op1
from calibrant.llm import op3_langid as op3
from calibrant.llm import op4_simhash as op4
from calibrant.llm import op6_urls as op6
from calibrant.llm import op8_bpe as op8
from calibrant.llm import op9_decontam as op9
from calibrant.llm import op10_warc as op10
from calibrant.llm.common import Scratch

FILE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_products_of_large_vectors(spark):
    """Components up to 64 bits; scores beyond them are clamped and ranked exactly."""
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=4) * 10.0 ** r.integers(0, 8)]) for i in range(300)] + [(300, [1e8, 0.5, 0.0, 1.0]), (301, [3e38, -1e300, 1.0, 1.0]), (350, [-3e38, 2.0, 1.0, 1.0])]
    got = op1.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 50 = 0", Scratch(spark), bucket_rows=60).collect()
    clamp = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    whole = [(i, [clamp(math.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for q, v in whole:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in whole if c != q)[:5]
            want += [(q, k + 1, c, clamp(-s)) for k, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_long_words(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (257, 3000, 40_000)] + ["ab" * 4000, "a" * 5001, "é" * 900, " " * 700, "-=" * 800, "the" * 3000]
    rows = [(i, w) for i, w in enumerate(words)] + [(90, "x " + words[1] + " " + words[3] + "!" * 999)]
    got = op8.digest(op8.bpe_round_trip(spark.createDataFrame(rows, "doc_id long, text string"), FILE)).collect()
    assert sorted(map(tuple, got)) == sorted(op8.by_library(rows, FILE))


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert op8.bpe_round_trip(none, FILE).count() == 0
    assert op4.near_duplicates(none, Scratch(spark)).count() == 0
    d = "file://" + tempfile.mkdtemp()
    none.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert cp.run(spark, d).count() == 0


def test_language_scores_and_sample(spark):
    """Scores of whole texts by a loop over their grams; a sample of the same size for each language."""
    r = random.Random(5)
    rows = [(i, "".join(r.choices("abcdefgh " if i % 3 else "mnopqrs ", k=60)), "x%02d" % (i % 3)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = op3.sample(df, per_lang=40, total=90)
    assert Counter(lang for lang, _ in taken) == {"x00": 30, "x01": 30, "x02": 30}
    assert set(Counter(lang for lang, _ in op3.sample(df, langs=2))) == {"x00", "x01"} or len(set(lang for lang, _ in op3.sample(df, langs=2))) == 2
    model = op3.train(op3.sample(df))
    for text in ("Ab, Cd", "a", "mn1op  qr\nÀ", "x" * 300_000 + " y"):
        raw = np.frombuffer(text.encode(), np.uint8)
        low, off = op3.letters(raw, np.array([0, len(raw)]))
        total, count = np.zeros(len(model.langs)), 0
        for g in op3.GRAMS:
            for i in range(len(low) - g + 1):
                code = int.from_bytes(low[i : i + g].tobytes(), "big")
                total += model.table[((code + g * 0x3C6EF372) % 2**32) * 0x9E3779B1 % 2**32 >> 15]
                count += 1
        assert np.allclose(op3.scores(model, raw, np.array([0, len(raw)]))[0], total / max(count, 1) + model.bias, atol=1e-3)


def test_url_odds_by_hand(spark):
    """Posterior of every page against a plain multinomial naive Bayes learnt from the pages that rules judge; splits of unseen names by trying all of them."""
    rules = (("block", "bad.io", "/"), ("allow", "good.io", "/"))
    hosts = ["win-casino.bad.io", "casino-farm.bad.io", "gardennews.good.io", "farm-news.good.io", "wincasino.com", "garden-news.com", "casinogarden.io", "x" * 70 + ".com", "bad.com"]
    rows = [(i, f"http://{h}/{p}", "<title>garden news win farm</title>") for i, (h, p) in enumerate((h, p) for h in hosts for p in ("a/1", "b/22", "pics/3", "q"))][:-1]
    got = {x["page_id"]: x for x in op6.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark), rules).collect()}
    cuts = {"gardennews": ["garden", "news"], "wincasino": ["win", "casino"], "casinogarden": ["casino", "garden"], "com": ["c", "o", "m"]}
    docs = []
    for i, url, _ in rows:
        h, p = url[7:].split("/", 1)
        words = [w for label in h.replace("-", ".").split(".") if label not in ("bad", "good", "io") for w in cuts.get(label, [label])]
        said = "block" if h.endswith("bad.io") else "allow" if h.endswith("good.io") else None
        docs.append((i, said, ["h:" + w for w in words] + ["p:" + w for w in p.translate(str.maketrans("123456789", "000000000")).split("/")]))
    count = {c: Counter(t for _, s, ts in docs if s == c for t in ts) for c in ("block", "allow")}
    seen = set(count["block"]) | set(count["allow"])
    share = lambda c, t: (count[c][t] + 1) / (sum(count[c].values()) + len(seen))
    for i, said, ts in docs:
        odds = sum(math.log(share("block", t) / share("allow", t)) for t in ts if t in seen)  # as many pages of either class
        assert abs(got[i]["block_odds"] - odds) < 1e-6, (i, ts)
        assert got[i]["verdict"] == (said or ("block" if odds > 0 else "allow"))
    assert {got[i]["verdict"] for i in range(16, 20)} == {"block"} and {got[i]["verdict"] for i in range(20, 24)} == {"allow"}
    words = {"a": 5, "ab": 9, "abc": 2, "bc": 7, "c": 1, "cab": 3}
    for label in ("abcab", "cabc", "xabc", "bcbc"):
        cuts = [[label[i:j] for i, j in zip((0, *c), (*c, len(label)), strict=True)] for m in range(1 << (len(label) - 1)) for c in [[k + 1 for k in range(len(label) - 1) if m >> k & 1]]]
        cost = lambda ws: sum(-math.log(words[w] / 27) if w in words else (math.log(28) + 12 if len(w) == 1 else math.inf) for w in ws)
        assert abs(cost(op6.viterbi(label, words, 27)) - min(map(cost, cuts))) < 1e-9


def test_items_in_blocks_and_a_long_text(spark):
    r = random.Random(6)
    word = ["".join(r.choices("abcdefghij", k=r.randrange(3, 8))) for _ in range(3000)]
    text = lambda n: " ".join(r.choices(word, k=n))
    items = [(i, text(r.randrange(10, 40))) for i in range(20)] + [(50, "two words")]
    rows = [(i, " ".join([text(50), items[i % 21][1], text(50)])) for i in range(60)] + [(99, " ".join([text(150_000), items[3][1], text(150_000)]))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, items[i % 21][0]) for i in range(60)} | {(99, 3)}
    for block in (500, 6):
        assert {(x["doc_id"], x["item_id"]) for x in op9.contaminated(docs, bench, Scratch(spark), block=block).collect()} == want


def test_long_page_and_file_bound(spark):
    pages = spark.createDataFrame([(1, "u", "<p>" + "x1é\r\n" * 600_000), (2, "u", "y"), (3, "v", "<p>" + "x1é\r\n" * 600_000)], "page_id long, url string, html string")
    got = {x["page_id"]: x for x in op10.round_trip(pages, Scratch(spark)).collect()}
    assert got[1]["payload_bytes"] == got[3]["payload_bytes"] == 3 + 6 * 600_000 and (got[1]["record_type"], got[1]["refers_to"], got[3]["record_type"]) == ("revisit", 3, "response")
    with pytest.raises(ValueError, match="a file of"):
        op10.write_warc(pages, "unused", segment=1 << 20, file_records=1000)


def test_pipeline_with_hot_copies_and_null_ids(spark):
    """A third of all rows is one text; rows without an id are judged by their text; a shared id does not drag a clean row along."""
    r = random.Random(12)
    word = ["".join(r.choices("abcdefghijklm", k=r.randrange(2, 8))) for _ in range(4000)]
    text = lambda n: " ".join(r.choices(word, k=n))
    item, hot = text(40), text(90)
    rows = [(i, text(80), "xa", "s", 1) for i in range(60)] + [(1000 + i, hot, "xa", "s", 1) for i in range(30)]
    rows += [(None, text(60) + " " + item, "xa", "s", 1), (None, text(80), "xa", "s", 1), (7, text(50) + " " + item + " " + text(20), "xa", "s", 1)]
    d = "file://" + tempfile.mkdtemp()
    spark.createDataFrame(rows, DOCS).withColumn("kd", F.lit("extra")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = [x["doc_id"] for x in cp.run(spark, d).collect()]
    assert sorted(i for i in got if i is not None) == [*range(60), 1000] and got.count(None) == 1
