"""Fusion of ranked lists and of answer probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
WEIGHTS = {"rag": 0.6, "other": 0.4}


def rrf(hits: DataFrame, doc: str = "doc", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``(sample_id, query_no, rank, doc)``, keyed by the text's SHA-256; ties by first appearance."""
    seen = F.struct("query_no", "rank")
    out = hits.groupBy("sample_id", F.sha2(F.col(doc), 256).alias("doc_key")).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"), F.min(seen).alias("seen"), F.min(doc).alias(doc))
    w = Window.partitionBy("sample_id").orderBy(F.desc("rrf"), "seen")
    return out.withColumn("position", F.row_number().over(w)).select("sample_id", "doc_key", doc, "rrf", "position")


def ensemble(members: DataFrame, weighted: bool = True) -> DataFrame:
    """``(sample_id, member, weight, opt, p)`` to the weighted mean of each option; a member without the option counts 1/n."""
    options = members.select("sample_id", "opt").distinct()
    weight = F.greatest(F.max("weight") if weighted else F.lit(1.0), F.lit(1e-10))
    who = members.groupBy("sample_id", "member").agg(weight.alias("w"), F.count(F.lit(1)).alias("n"))
    full = options.join(who, "sample_id").join(members.select("sample_id", "member", "opt", "p"), ["sample_id", "member", "opt"], "left")
    full = full.withColumn("p", F.coalesce("p", 1.0 / F.col("n")))
    return full.groupBy("sample_id", "opt").agg(F.round(F.sum(F.col("w") * F.col("p")) / F.sum("w"), 9).alias("p"))


def fuse(left: DataFrame, right: DataFrame, strategy: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Full outer join on option, missing is 0, then renormalised; uniform if nothing is left."""
    a, b = F.coalesce("pa", F.lit(0.0)), F.coalesce("pb", F.lit(0.0))
    total = sum(weights.values())
    how = {"weighted": a * F.lit(weights["rag"] / total) + b * F.lit(weights["other"] / total), "max": F.greatest(a, b), "average": (a + b) / 2}
    if strategy not in how:
        raise ValueError(f"unknown fusion strategy {strategy!r}; known: {sorted(how)}")
    both = left.withColumnRenamed("p", "pa").join(right.withColumnRenamed("p", "pb"), ["sample_id", "opt"], "full_outer").withColumn("x", how[strategy])
    w = Window.partitionBy("sample_id")
    return both.withColumn("p", F.when(F.sum("x").over(w) > 0, F.col("x") / F.sum("x").over(w)).otherwise(1.0 / F.count(F.lit(1)).over(w))).select("sample_id", "opt", F.round("p", 9).alias("p"))


def max_over_positions(rows: DataFrame, by: str = "sample_id") -> DataFrame:
    """``(by, opt, p)`` at several positions (generated tokens, passages): the best of each option, at least 0, renormalised; uniform if all are 0."""
    best = rows.groupBy(by, "opt").agg(F.greatest(F.max("p"), F.lit(0.0)).alias("m"))
    w = Window.partitionBy(by)
    return best.select(by, "opt", F.round(F.when(F.sum("m").over(w) > 0, F.col("m") / F.sum("m").over(w)).otherwise(1.0 / F.count(F.lit(1)).over(w)), 9).alias("p"))


def uniform(options: Column) -> Column:
    """1/n for each option."""
    return F.transform(options, lambda o: F.lit(1.0) / F.size(options))


def option_logits(options: Column, top: Column, missing: float = float("-inf")) -> Column:
    """Logits of the options from the last token's ``map<string, double>`` of best log probabilities; the others have ``missing``."""
    return F.transform(options, lambda o: F.coalesce(F.try_element_at(top, o), F.lit(missing)))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits; uniform where no logit is finite."""
    best = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - best))
    return F.when(best > float("-inf"), F.transform(F.array(e), lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y)))[0]).otherwise(uniform(logits))


def best_candidate(candidates: DataFrame, w_rel: float = 1.0, w_sup: float = 1.0, w_use: float = 0.5) -> DataFrame:
    """``(sample_id, candidate, relevance, support, utility)``: the first of highest composite score; defaults .5, .5, 3."""
    score = w_rel * F.coalesce("relevance", F.lit(0.5)) + w_sup * F.coalesce("support", F.lit(0.5)) + w_use * F.coalesce("utility", F.lit(3)) / 5
    w = Window.partitionBy("sample_id").orderBy(F.desc("composite"), "candidate")
    return candidates.withColumn("composite", F.round(score, 9)).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def fan_out(samples: DataFrame) -> DataFrame:
    """Contexts '', the first three documents, all documents; with documents the empty one is skipped, without them it comes three times."""
    docs = F.col("docs")
    contexts = F.array(F.lit(""), F.array_join(F.slice(docs, 1, 3), "\n"), F.array_join(docs, "\n"))
    return samples.select("sample_id", "docs", F.posexplode(contexts).alias("candidate", "context")).where((F.col("context") != "") | (F.size("docs") == 0)).drop("docs")
