r"""Sentence boundaries by abbreviations that the corpus itself shows (after Kiss and Strunk, 2006).

Words that stand before a period far more often than chance allows, that are short and seldom stand without one, are abbreviations.  Their statistics are
counted by Spark over the whole corpus.  A candidate is a run of ``.!?`` (and closing quotes or brackets) before white space, so a decimal point is none:

* ``!`` or ``?``: a boundary.  Two or more periods: a boundary unless a lower-case letter follows.
* A capital letter alone (``J.``): none.  A number: a boundary unless a lower-case letter follows.
* An abbreviation, or single letters with periods between (``e.g.``): none, unless a capital follows whose word the corpus has in lower case as well.
* Any other word: a boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrant.operators.search import small
from calibrant.sources.tables import Workspace

#: A text between two candidates, with the white space behind it; the last one has no mark.
SEGMENT = r"(?s)\S.*?[.!?]+[\"')\]]*\s+|\S.*"
ENOUGH, ALTERNATIVE = 0.3, 0.99


def bare(token: Column) -> Column:
    """The token without closing quotes and brackets.  The look-behinds here keep the search linear in long runs."""
    closed = F.substring(token, -1, 1).isin('"', "'", ")", "]")
    return F.when(closed, F.regexp_replace(token, r"(?<![\"')\]])[\"')\]]+\z", "")).otherwise(token)


def word_type(token: Column) -> Column:
    """Lower case, without what is neither letter nor digit at both ends."""
    plain = F.substring(token, 1, 1).rlike(r"[\p{L}\p{N}]") & F.substring(token, -1, 1).rlike(r"[\p{L}\p{N}]")  # most tokens
    return F.when(plain, F.lower(token)).otherwise(F.lower(F.regexp_replace(token, r"\A[^\p{L}\p{N}]+|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]+\z", "")))


def dotted(token: Column) -> Column:
    return token.rlike(r"[^.!?]\.\z")


def vocabulary(docs: DataFrame) -> DataFrame:
    """``type, n, dotted, lowered``: words of ``docs (text)``, how often in all, before one period, and with a small first letter."""
    token = bare(F.col("token"))
    words = docs.select(F.explode(F.split("text", r"\s+")).alias("token")).where("token <> ''")
    words = words.select(word_type(token).alias("type"), dotted(token).alias("dotted"), token.rlike(r"\A[^\p{L}\p{N}]*\p{Ll}").alias("lowered"))
    return words.where("type <> ''").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if("dotted").alias("dotted"), F.count_if("lowered").alias("lowered"))


def abbreviations(words: DataFrame, enough: float = ENOUGH) -> DataFrame:
    """``type, score`` of a ``vocabulary``: the log-likelihood ratio of word and period, less for length and for each time without a period, more for inner periods."""
    total = words.agg((F.sum("dotted") / F.sum("n")).alias("chance"))
    c, n = F.col("dotted"), F.col("n")

    def likelihood(p: Column) -> Column:
        return c * F.log(p) + (n - c) * F.log(1 - p)

    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    score = 2 * (likelihood(F.lit(ALTERNATIVE)) - likelihood(F.col("chance"))) * F.exp(-letters) * (F.length("type") - letters + 1) * F.pow(letters.cast("double"), (c - n).cast("double"))
    kept = words.where(r"dotted > 0 and type rlike '\\p{L}'").join(F.broadcast(total), F.lit(True)).where("chance < 1")
    return kept.select("type", score.alias("score")).where(F.col("score") >= enough)


def sentences(docs: DataFrame, key: list[str], text: str, workspace: Workspace, least: int = 10, most: int = 1000, corpus: DataFrame | None = None) -> DataFrame:
    """``*key, chunk_id, chunk``: sentences of more than ``least`` characters, cut to ``most`` afterwards.

    Abbreviations are learnt from ``corpus (text)``, by default from the texts themselves.  Rows with equal or null keys are told apart; a null or blank text has no sentence.
    """
    learnt = docs.select(F.col(text).alias("text")) if corpus is None else corpus
    words = workspace.step("vocabulary", lambda: vocabulary(learnt))
    found = F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(0))
    pairs = F.flatten(F.transform(F.array(found), lambda v: F.transform(v, lambda s, i: F.struct(s.alias("segment"), F.get(v, i + 1).alias("next")))))

    def cut() -> DataFrame:
        rows = docs.where(F.col(text).isNotNull()).withColumn("__row", F.monotonically_increasing_id()).select(F.struct(*key).alias("key"), F.col("__row").alias("row"), F.posexplode(pairs).alias("i", "x"))
        token = bare(F.element_at(F.split(F.regexp_replace("x.segment", r"(?<!\s)\s+\z", ""), r"\s+"), -1))
        behind = F.element_at(F.split("x.next", r"\s+", 2), 1)
        return rows.select(
            "key", "row", "i", F.col("x.segment").alias("segment"), token.alias("token"), word_type(token).alias("type"), word_type(bare(behind)).alias("next_type"),
            behind.rlike(r"\A[^\p{L}\p{N}]*\p{Lu}").alias("up"), behind.rlike(r"\A[^\p{L}\p{N}]*\p{Ll}").alias("low"),
        )

    segments = workspace.step("segments", cut)
    initial, number, ellipsis = F.col("token").rlike(r"\A[^\p{L}\p{N}]*\p{Lu}\.\z"), F.col("type").rlike(r"\A[0-9]+\z"), F.col("token").rlike(r"\.\.\z")
    letters = F.col("type").rlike(r"\A(\p{L}\.)+\p{L}\z")
    one = dotted(F.col("token"))
    clear = F.when(one, initial | (number & F.col("low"))).otherwise(ellipsis & F.col("low"))
    open_ = segments.where(one & ~initial & ~number & F.col("next_type").isNotNull()).select("row", "i", "type", "next_type", "up", letters.alias("letters"))
    short = open_.where("letters").unionByName(open_.where("not letters").join(small(abbreviations(words).select("type")), "type", "left_semi").select(*open_.columns))
    lowered = words.where("lowered > 0").select(F.col("type").alias("next_type"))
    glued = short.where("not up").unionByName(short.where("up").join(lowered, "next_type", "left_anti").select(*short.columns))
    marked = segments.join(small(glued.select("row", "i", F.lit(True).alias("glued"))), ["row", "i"], "left")
    ends = F.when(clear | F.coalesce("glued", F.lit(False)), 0).otherwise(1)
    order = Window.partitionBy("row").orderBy("i")
    counted = marked.withColumn("ends", ends).withColumn("no", F.sum("ends").over(order) - F.col("ends"))
    whole = F.array_join(F.sort_array(F.collect_list(F.struct("i", "segment")))["segment"], "")
    found = counted.groupBy("row", "no").agg(F.first("key").alias("key"), F.regexp_replace(whole, r"(?<!\s)\s+\z", "").alias("chunk")).where(F.length("chunk") > least)
    position = F.row_number().over(Window.partitionBy("row").orderBy("no")) - 1
    return found.select("key.*", position.alias("chunk_id"), F.substring("chunk", 1, most).alias("chunk"))
