"""Operator 6: URL filtering by rules, and by naive Bayes on segmented host words where no rule fits.

Word counts come from all page titles, path words and the words of hyphenated host labels.  A host's labels are cut into words by
unigram Viterbi: every substring of the distinct labels is looked up in the counts by a join (the dictionary is never
broadcast), and the best split is found label by label.  A label has at most 63 characters; what is longer cannot be a host's and stays one word.
Pages that a rule judges are the labelled rows of a multinomial naive Bayes over host and path words (digits count by their number); the
labels of the rules' own host names are left out of it, as every labelled page holds them.  URLs that no rule fits are judged by its posterior with add-one
smoothing of classes and words, ``allow`` at a tie and where nothing is labelled.  ``seeds`` (none by default) are host words
that label pages without a rule as ``block``.

Work is done once for each distinct pair of host and path shape (digits levelled), with pre-aggregated counts, so a hot host is
one row until the verdicts are joined back; rows of hosts, words and shapes that stand in very many rows are not exchanged by the joins.

Edge cases: null url and url without ``://``: host and path are empty, no rule fits; null ids are ordinary rows; repeated rows
repeat in the result; an empty table gives an empty one; titles are read whole; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .repeats import heavy, split_join

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest label of a host name (fixed value).
LABEL = 63


def parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as ``struct<rule, verdict>``; null if none."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def viterbi(label: str, words: dict[str, int], total: int) -> list[str]:
    """The split of least cost; a letter that is no word costs more than any word."""
    unknown = math.log(total + 1) + 12.0
    best: list[tuple[float, int]] = [(0.0, 0)]
    for e in range(1, len(label) + 1):
        found = [(best[e - 1][0] + unknown, e - 1)]
        for s in range(e):
            if c := words.get(label[s:e]):
                found.append((best[s][0] - math.log(c / total), s))
        best.append(min(found))
    out, e = [], len(label)
    while e:
        s = best[e][1]
        out.append(label[s:e])
        e = s
    return out[::-1]


def segment(total: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [viterbi(label, {x["w"]: x["c"] for x in known}, total) for label, known in zip(pdf["label"], pdf["known"], strict=True)]
            yield pd.DataFrame({"label": pdf["label"], "words": words})

    return run


def filter_urls(pages: DataFrame, scratch: Scratch, rules=RULES, seeds: tuple[str, ...] = ()) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_odds`` of every row."""
    none = F.array().cast("array<string>")
    host, path = parts(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"), F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    base = base.withColumns({"hit": rule_of(F.col("host"), F.col("path"), rules), "shape": F.translate("path", "123456789", "000000000")})
    base = base.withColumn("site", F.concat("host", F.lit("\n"), "shape"))
    base = scratch.keep(base.select("page_id", "host", "path", "shape", "site", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("said"), F.lower("title").alias("title")), "urls")
    texts = base.select(F.explode(F.split(F.concat_ws(" ", "title", F.lower("path")), r"[^\p{L}]+")).alias("w"))
    of = lambda verdict: F.sum((F.col("said") == verdict).cast("long")).alias(verdict)
    sites = base.groupBy("site", "host", "shape").agg(F.count(F.lit(1)).alias("n"), of("block"), of("allow"))
    sites = scratch.keep(sites.fillna(0, ["block", "allow"]), "sites")
    hosts = sites.groupBy("host").agg(F.count(F.lit(1)).alias("k"))
    hyphenated = hosts.select(F.explode(F.filter(F.split("host", r"\."), lambda x: x.contains("-"))).alias("l")).select(F.explode(F.split("l", r"[^\p{L}]+")).alias("w"))
    counts = texts.union(hyphenated).where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    counts = scratch.keep(counts, "word-counts")
    total = counts.agg(F.sum("c")).first()[0] or 1
    labels = hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}]+")).alias("i", "label")).where("label <> ''")
    distinct = labels.where(F.length("label") <= LABEL).select("label").distinct()
    length = F.length("label")
    pieces = distinct.select("label", F.explode(F.sequence(F.lit(1), length)).alias("s")).select("label", "s", F.explode(F.sequence(F.lit(1), length - F.col("s") + 1)).alias("n"))
    pieces = pieces.select("label", F.substring("label", F.col("s"), F.col("n")).alias("w")).distinct()
    known = pieces.join(counts, "w").groupBy("label").agg(F.collect_list(F.struct("w", "c")).alias("known"))
    cut = distinct.join(known, "label", "left").withColumn("known", F.coalesce("known", F.array().cast("array<struct<w:string,c:bigint>>")))
    cut = cut.mapInPandas(segment(int(total)), "label string, words array<string>")
    own = sorted({x for _, h, _ in rules for x in h.lower().split(".")})
    used = labels.where(~F.col("label").isin(own)) if own else labels
    uses = scratch.keep(used.groupBy("label").agg(F.count(F.lit(1)).alias("uses")).join(cut, "label", "left"), "label-words")
    uses = uses.withColumn("words", F.coalesce("words", F.array("label")))
    named = split_join(used, uses, ["label"], heavy(uses, "label", "uses")).groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "words"))), lambda x: x["words"])).alias("words"))
    named = scratch.keep(hosts.join(named, "host", "left").withColumn("words", F.coalesce("words", none)), "host-words")
    in_path = F.filter(F.split(F.regexp_replace(F.lower("shape"), "(0+)", " $1 "), r"[^\p{L}0]+"), lambda x: x != "")
    tokens = split_join(sites, named, ["host"], heavy(named, "host", "k"))
    tokens = tokens.withColumn("tokens", F.concat(F.transform("words", lambda x: F.concat(F.lit("h:"), x)), F.transform(in_path, lambda x: F.concat(F.lit("p:"), x))))
    if seeds:
        seeded = F.arrays_overlap("words", F.array(*map(F.lit, seeds)))
        tokens = tokens.withColumn("block", F.when(seeded, F.col("n") - F.col("allow")).otherwise(F.col("block")))
    tokens = scratch.keep(tokens.select("site", "n", "block", "allow", "tokens"), "site-tokens")
    each = tokens.select("site", "block", "allow", F.explode("tokens").alias("token"))
    model = scratch.keep(each.groupBy("token").agg(F.sum("block").alias("b"), F.sum("allow").alias("a"), F.count(F.lit(1)).alias("rows")), "token-counts")
    sums = model.agg(F.sum("b"), F.sum("a"), F.sum(((F.col("a") > 0) | (F.col("b") > 0)).cast("long"))).first()
    docs = tokens.agg(F.sum("block"), F.sum("allow")).first()
    nb, na, v = (float(x or 0) for x in sums)
    prior = math.log(((docs[0] or 0) + 1) / ((docs[1] or 0) + 1))
    # words that no labelled page holds say nothing about a class
    odds = model.where("a + b > 0").select("token", (F.log((F.col("b") + 1) / F.lit(nb + v)) - F.log((F.col("a") + 1) / F.lit(na + v))).alias("w"))
    judged = split_join(each, odds, ["token"], heavy(model, "token", "rows")).groupBy("site").agg(F.sum("w").alias("w"))
    judged = tokens.select("site", "n").join(judged, "site", "left")
    judged = scratch.keep(judged.select("site", "n", (F.round(F.coalesce("w", F.lit(0.0)), 9) + F.lit(prior)).alias("block_odds")), "site-odds")
    out = split_join(base, judged, ["site"], heavy(judged, "site", "n"))
    verdict = F.when(F.col("block_odds") > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", verdict).alias("verdict"), "block_odds")
