"""Operators 3, 6, 9, 10 and the pipeline on small fixtures."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from calibrant.llm import op3_langid as op3
from calibrant.llm import op6_urls as op6
from calibrant.llm import op9_decontam as op9
from calibrant.llm import op10_warc as op10
from calibrant.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r: random.Random, letters: str, n: int) -> str:
    return " ".join("".join(r.choices(letters, k=r.randrange(2, 8))) for _ in range(n))


def documents() -> list[tuple]:
    r = random.Random(5)
    rows = [(i, prose(r, "abcdefg" if i % 2 else "mnopqrsé", r.randrange(20, 80)), "xa" if i % 2 else "yb", "s", 1) for i in range(160)]
    return [*rows, (500, None, None, None, None), (501, "", "xa", "s", 0), (502, "12 34 !!", "xa", "s", 8), (None, rows[0][1], None, "s", 1), rows[3]]


def test_language_id(spark):
    rows = documents()
    out = op3.language_id(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    by = {x["doc_id"]: x for x in out}
    assert {by[i]["lang_pred"] for i in (500, 501, 502)} == {"und"} and all(by[i]["score"] == 0 and by[i]["rejected"] for i in (500, 501, 502))
    held = [(by[x[0]]["lang_pred"], x[2]) for x in rows if x[0] is not None and x[0] < 500 and by[x[0]]["held_out"]]
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) >= 0.97
    assert all(0 <= x["score"] <= 1 for x in out)
    none = op3.language_id(spark.createDataFrame([], DOCS))
    assert none.count() == 0
    assert op3.language_id(spark.createDataFrame([(1, "abc", None, None, None)], DOCS)).first()["lang_pred"] == "und"


def test_urls(spark):
    urls = ["http://a.com/en/x", "http://Example.COM/en/7?q", "https://www.example.com/en/71#x", "http://example.com/en/8", "http://x.net/de/", "http://example.net/de/8", "http://xcom/en/", "http://o.org/es", "http://o.org/es/", None, "", "no scheme", "ftp://h?/x", "http://h#://z", "http://www.cheappills.io/fr/1", "http://cheap-pills.io/fr/22", "http://gardennews.io/fr/1"] + ["http://garden.io/fr/%d" % i for i in range(30)]
    rows = [(i, u, "<title>Garden news</title>", 1) for i, u in enumerate(urls)] + [(None, urls[0], None, 1), (0, urls[0], "", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule int")
    got = op6.filter_urls(pages, Scratch(spark)).collect()
    assert len(got) == len(rows)

    def want(u):
        if not u or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fit = [(len(h + p), h + p) for _, h, p in op6.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit)[1] if fit else None

    by = {x["page_id"]: x for x in got}
    for i, u in enumerate(urls):
        assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == want(u), u
    verdict = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {h + p: v for v, h, p in op6.RULES} == verdict
    assert all(x["verdict"] == verdict[x["rule"]] for x in got if x["rule"])
    seeded = {x["page_id"]: x["verdict"] for x in op6.filter_urls(pages, Scratch(spark), seeds=("pills",)).collect()}
    assert [seeded[i] for i in (14, 15)] == ["block", "block"]
    alone = op6.filter_urls(pages.where("page_id >= 14"), Scratch(spark)).collect()  # nothing is labelled
    assert alone and all(x["verdict"] == "allow" and x["block_odds"] == 0 for x in alone)
    assert op6.viterbi("cheappills", {"cheap": 5, "pills": 4, "heap": 1}, 20) == ["cheap", "pills"]
    assert op6.filter_urls(spark.createDataFrame([], "page_id long, url string, html string"), Scratch(spark)).count() == 0


def test_decontamination(spark):
    r = random.Random(3)
    word = [prose(r, "abcdefghij", 1) for _ in range(3000)]
    text = lambda n: " ".join(r.choices(word, k=n))
    items = [(i, text(r.randrange(15, 60)), 1) for i in range(30)] + [(90, None, 1), (91, "", 1), (92, "short item", 1), (None, text(30), 1)]
    rows = [(i, text(r.randrange(0, 300)), "x") for i in range(120)]
    for i in range(20):
        item = items[i][1].split()
        if i % 2:  # a paraphrase: some words replaced
            for k in range(0, len(item), 9):
                item[k] = r.choice(word)
        rows.append((200 + i, " ".join([text(40), " ".join(item).upper() if i % 3 == 0 else "\n".join(item), text(30)]), "x"))
    rows += [(300, None, None), (301, "", None), (None, items[2][1], None), rows[125], rows[125]]
    got = {(x["doc_id"], x["item_id"]) for x in op9.contaminated(spark.createDataFrame(rows, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, doc_id int"), Scratch(spark)).collect()}
    assert {(200 + i, i) for i in range(20)} | {(None, 2)} == got
    assert got == op9.brute_force([x[:2] for x in rows], [x[:2] for x in items])
    assert op9.contaminated(spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string"), Scratch(spark)).count() == 0


@pytest.mark.parametrize("segment", [50, 100_000])
def test_warc(spark, segment):
    r = random.Random(2)
    html = [prose(r, "abcé\r\n", 400) for _ in range(5)]
    rows = [(i, f"http://h/{i}\r\nx", html[i % 5] if i % 3 else html[i % 5][:200], 1) for i in range(40)]
    rows += [(100, None, None, 1), (101, "", "", 1), (102, "u", "\r\n\r\n" * 400, 1), (None, "u", html[1], 1), rows[7], rows[7], (103, "u", "0\r\n\r\n", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = op10.round_trip(df, Scratch(spark), segment=segment, chunk=64, file_records=7).collect()
    want, most = [], {}
    for i, _, h, _ in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            most[h] = max(most.get(h, i), i)
    for i, _, h, _ in rows:
        b = (h or "").encode()
        main = most.get(h) if len(b) >= 1000 else None
        again = main is not None and main != i
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", main if again else None))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert op10.round_trip(df.limit(0), Scratch(spark)).count() == 0


def test_warc_reports_damage():
    with pytest.raises(ValueError):
        list(op10.parse(op10.header([("WARC-Type", "response")], b"abc") + b"\r\n"))
    with pytest.raises(ValueError):
        op10.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    r = random.Random(11)
    word = [prose(r, "abcdefghijklm", 1) for _ in range(4000)]
    text = lambda n: " ".join(r.choices(word, k=n))
    passage, item = text(90), text(40)
    rows = [(i, text(r.randrange(60, 200)), "xa", "s", 1) for i in range(60)]
    rows += [(100, rows[4][1], "xa", "s", 1), (101, rows[4][1], "xa", "s", 1), (102, text(50) + " " + passage + " " + text(50), "xa", "s", 1), (103, text(50) + " " + passage + " " + text(50), "xa", "s", 1), (104, text(30) + " " + item + " " + text(30), "xa", "s", 1), (105, "123", "xa", "s", 3), (106, None, None, None, None), rows[9]]
    docs = spark.createDataFrame(rows, DOCS)
    scratch = Scratch(spark)
    import tempfile

    d = "file://" + tempfile.mkdtemp()
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    ids = {}
    for name, stage in cp.STAGES:
        docs = scratch.keep(stage(spark, docs, d), name)
        ids[name] = sorted(x["doc_id"] for x in docs.select("doc_id").collect())
        if name != "tokenise":
            assert docs.columns == list(cp.COLUMNS)
        if name == "suffix_dedup":
            cut = {x["doc_id"]: x["text"] for x in docs.where(F.col("doc_id").isin(3, 102, 103)).collect()}
    base = set(range(60))
    assert set(ids["language_id"]) == base | {100, 101, 102, 103, 104}
    assert ids["near_dedup"] == sorted(base | {102, 103, 104})
    assert ids["suffix_dedup"] == ids["near_dedup"] and passage[50:300] not in cut[102] + cut[103] and cut[3] == rows[3][1]
    assert ids["tokenise"] == sorted(base | {102, 103})
