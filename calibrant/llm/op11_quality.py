"""Operator 11: quality rules whose cutoffs are certified on labelled documents.

A rule rejects a document whose measure (in thousandths) reaches a cutoff.  The labelled texts of a stratum (a language) that pass the base rule are
dealt into two halves by a digest of the text, copies counted once:

* the tuning half picks the rules that are worth it and a cutoff for each: rejected bad texts less ``GOOD_WEIGHT`` times the rejected good ones, ties
  to the middle of the tied cutoffs;
* the holdout certifies.  A cutoff passes while the exact binomial tail P(Bin(n, risk) <= rejected good texts) is at most the level, so with
  Clopper and Pearson's bound its false rejection rate lies under ``risk``.  Cutoffs are tested from the most lenient on and the first that fails ends
  the sequence, which needs no correction; the level is ``delta`` divided by the number of all (stratum, rule) pairs tested (Bonferroni), and the
  risk of a stratum is divided among its rules.  A tuned cutoff that is not certified is moved to the strictest certified one.

So with probability 1 - ``delta``, in every stratum at once, the rules together reject at most ``RISK`` of the good documents that pass the base rule.
A stratum with too few labelled texts has no rules.  Counts of labels by (stratum, rule, measure) are all that is gathered.

Edge cases: null and empty texts have no words and fail the base rule; a null language is a stratum of its own; labels without a quality are ignored, of
several labels of an id, or of copies, the best one holds; null ids have no label; repeated rows are judged each; long texts are measured whole; an empty
table, or one without labels, works (no rules); columns other than doc_id, text, lang (doc_id, quality of labels) are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, flat, slices
from .rolling import SPACE, words

WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
RISK, DELTA, GOOD_WEIGHT = 0.1, 0.1, 5
#: Strata whose cutoffs are broadcast; more are joined by a shuffle.
FEW_STRATA = 10_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LOUD = np.zeros(256, bool)
_LOUD[list(b"!?")] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_loud", "n_capitals", "n_stutter")
#: Rule: (count, what it is a share of).
RULES = {
    "capitals": ("n_capitals", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "loud": ("n_loud", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "stutter": ("n_stutter", "n_words"),
    "symbols": ("n_symbols", "word_chars"),
}


def _ids(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers that are equal where consecutive strings of these sizes are equal."""
    off = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=off[1:])
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy().astype(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (a, b), both below 2**31."""
    return pd.factorize(a * (int(b.max(initial=0)) + 1) + b)[0]


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of ``BASE`` and ``MORE`` for every document of a flat buffer."""
    n = len(off) - 1
    start, end, first = words(data, off)
    doc = np.repeat(np.arange(n), np.diff(first))
    per = lambda at: np.bincount(at, minlength=n)
    inside = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
    solid = ~SPACE[data]
    ids = _ids(data[solid], end - start)
    out = {
        "n_words": np.diff(first),
        "word_chars": inside(solid & ((data & 0xC0) != 0x80)),
        "n_symbols": inside(_SYMBOL[data]),
        "n_loud": inside(_LOUD[data]),
        "n_capitals": inside((data >= 65) & (data <= 90)),
        "n_stutter": per(doc[1:][(ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])]),
    }
    covered = np.zeros(len(ids) + 1, np.int64)
    if len(ids) >= WINDOW:
        two = _pairs(ids[:-1], ids[1:])
        five = _pairs(_pairs(two[:-2], two[2:])[:-1], ids[4:])
        at = np.flatnonzero(doc[4:] == doc[:-4])
        same = _pairs(doc[at], five[at])
        again = at[np.bincount(same)[same] > 1] if len(at) else at
        np.add.at(covered, again, 1)
        np.add.at(covered, again + WINDOW, -1)
    out["n_repeat_words"] = per(doc[np.cumsum(covered)[:-1] > 0])
    bounds = np.unique(np.concatenate([off, np.flatnonzero(data == 10) + 1]))
    line_doc = np.searchsorted(off, bounds[:-1], side="right") - 1
    line = _ids(data[data != 10], np.diff(bounds) - (data[bounds[1:] - 1] == 10) if len(bounds) > 1 else np.zeros(0, np.int64))
    worded = np.diff(np.searchsorted(start, bounds)) > 0
    out["n_lines"] = per(line_doc[worded])
    out["n_dup_lines"] = out["n_lines"] - per(np.unique(np.stack([line_doc[worded], line[worded]]), axis=1)[0])
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            names = [c for c in part.schema.names if c != "text"]
            found = measure(*flat(part.column("text")))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(found[c].astype(np.int64)) for c in (*BASE, *MORE))], names=[*names, *BASE, *MORE])


def tail(n: int, p: float, r: int) -> float:
    """P(Bin(n, p) <= r), summed from r downwards until nothing more is added."""
    if r < 0:
        return 0.0
    if r >= n:
        return 1.0
    total, at = 0.0, r
    base = math.lgamma(n + 1)
    while at >= 0:
        i = np.arange(max(0, at - 4095), at + 1)[::-1]
        logs = np.array([base - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in i.tolist()])
        part = float(np.exp(logs).sum())
        total += part
        at -= 4096
        if part <= total * 1e-17 and at < n * p:
            break
    return min(1.0, total)


def allowance(n: int, risk: float, level: float) -> int:
    """The most rejected good texts of n with a tail of at most ``level``; -1 if n is too small."""
    lo, hi = -1, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if tail(n, risk, mid) <= level else (lo, mid)
    return lo


COUNTED = "stratum string, rule string"


def _tuned(group: pd.DataFrame) -> pd.DataFrame:
    """The cutoff of one rule in one stratum, from the counts of the tuning half by measure; none if it gains nothing."""
    good, bad = (np.bincount(group["value"], weights=group[c], minlength=1001)[::-1].cumsum()[::-1][1:] for c in ("good", "bad"))  # by cutoff 1 .. 1000
    gain = bad - GOOD_WEIGHT * good
    top = int(np.flatnonzero(gain == gain.max())[-1])
    if gain[top] <= 0:
        return pd.DataFrame({"stratum": [], "rule": [], "tuned": []}).astype({"stratum": str, "rule": str, "tuned": np.int64})
    low = int(np.flatnonzero((good == good[top]) & (bad == bad[top]))[0])
    return pd.DataFrame({"stratum": group["stratum"].iloc[:1], "rule": group["rule"].iloc[:1], "tuned": [(low + top + 3) // 2]})


def _certified(risk: float, delta: float, tests: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        good = np.bincount(group["value"], weights=group["good"], minlength=1001)
        n, rejected = int(good.sum()), good[::-1].cumsum()[::-1][1:]
        most = allowance(n, risk / int(group["rules"].iloc[0]), delta / tests)
        passed = np.flatnonzero(rejected <= most) + 1
        cut = max(int(group["tuned"].iloc[0]), int(passed[0])) if len(passed) else None
        one = group.iloc[:1]
        return pd.DataFrame({"stratum": one["stratum"], "rule": one["rule"], "cutoff": pd.array([cut], "Int64"), "tuned": one["tuned"], "good": n, "allowed": most})

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, scratch: Scratch, risk: float = RISK, delta: float = DELTA) -> tuple[DataFrame, DataFrame]:
    """(verdicts, cutoffs): ``doc_id, lang``, the counts, ``base_failed, kept, rejected_by`` for each row; and ``stratum, rule, cutoff, tuned, good,
    allowed`` for each pair tested, cutoff null where none is certified."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", "lang", F.md5(text.cast("binary")).alias("digest"), text.alias("text"))
    counts = ", ".join(f"{c} long" for c in (*BASE, *MORE))
    kind = dict(slim.dtypes)
    rows = slim.mapInArrow(_measured, f"doc_id {kind['doc_id']}, lang {kind['lang']}, digest string, {counts}")
    rows = rows.withColumns({"stratum": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))})
    rows = rows.withColumns({f"m_{r}": F.least(F.lit(1000), F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1)))).cast("int") for r, (a, b) in RULES.items()})
    rows = scratch.keep(rows, "measures")

    told = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = rows.where("not base_failed").join(told, "doc_id").groupBy("stratum", "digest").agg(F.max("quality").alias("quality"), *(F.first(f"m_{r}").alias(f"m_{r}") for r in RULES))
    tuning = F.conv(F.substring("digest", 1, 1), 16, 10).cast("int") % 2 == 0
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"m_{r}").alias("value")) for r in RULES)))
    spread = texts.select("stratum", tuning.alias("tuning"), (F.col("quality") > 0).alias("is_good"), each.alias("e")).select("stratum", "tuning", "is_good", "e.*")
    hist = scratch.keep(spread.groupBy("stratum", "rule", "tuning", "value").agg(F.count_if("is_good").alias("good"), F.count_if(~F.col("is_good")).alias("bad")), "label-counts")
    tuned = scratch.keep(hist.where("tuning").groupBy("stratum", "rule").applyInPandas(_tuned, f"{COUNTED}, tuned long"), "tuned")
    tests = max(1, tuned.count())
    asked = hist.where("not tuning").join(tuned, ["stratum", "rule"]).join(tuned.groupBy("stratum").agg(F.count(F.lit(1)).alias("rules")), "stratum")
    cutoffs = scratch.keep(asked.groupBy("stratum", "rule").applyInPandas(_certified(risk, delta, tests), f"{COUNTED}, cutoff long, tuned long, good long, allowed long"), "cutoffs")

    wide = cutoffs.where("cutoff is not null").groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"c_{r}") for r in RULES))
    judged = rows.join(F.broadcast(wide) if cutoffs.count() <= FEW_STRATA * len(RULES) else wide, "stratum", "left")
    reasons = F.filter(F.array(*(F.when(F.col(f"m_{r}") >= F.col(f"c_{r}"), F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    judged = judged.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(F.array_join(reasons, ",")))
    return judged.withColumn("kept", F.col("rejected_by") == "").select("doc_id", "lang", *BASE, *MORE, "base_failed", "kept", "rejected_by"), cutoffs


def digest(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("doc_id", *BASE, "base_failed", "kept", "rejected_by")


def plain_counts(text: str | None) -> tuple[int, ...]:
    """``BASE`` and ``MORE`` by loops, for tests."""
    raw = (text or "").encode()
    w = raw.split()
    seen: dict = {}
    for i in range(len(w) - WINDOW + 1):
        seen.setdefault(tuple(w[i : i + WINDOW]), []).append(i)
    again = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(WINDOW)}
    lines = [x for x in raw.split(b"\n") if x.split()]
    count = lambda chars: sum((text or "").count(c) for c in chars)
    return (len(w), sum(len(x.decode()) for x in w), count("#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(lines), count("!?"), count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), sum(a == b for a, b in zip(w, w[1:], strict=False)))
