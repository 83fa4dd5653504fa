"""Answer probabilities from stored token logits.

``steps (sample_id, position, token)`` are the generated tokens; ``logits (sample_id, position, token, logit)`` is what the model gave the tokens of its
vocabulary at a position, before one was drawn; a scoring pass may have stored the position after the last step, too.  ``options (sample_id, opt)``.
Such long tables are exchanged by sample or position.  What a model gave may be stored as it comes, too, and is then read where it lies: ``answers_of`` takes a row for each sample,
``best_of`` a row for each position with its tokens in a list; only options are exchanged.
A logit that is null or not finite counts as missing; of a token that is stored twice the best logit counts; steps may lack a sample, and a sample its logits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibrant.operators import fusion
from calibrant.operators.search import small

MARKER = "Answer|"
#: The logit of an option that was not stored.
MISSING = -100.0
#: Different options that a task looks up.
MOST_OPTIONS = 10_000


def answer_positions(steps: DataFrame, marker: str = MARKER) -> DataFrame:
    """``sample_id, position, head``: where the token behind the last ``marker`` is drawn; behind the last token, if there is no marker.

    The marker may cross token borders.  If its end lies inside a token, ``head`` is the part of that token that belongs to the marker (else empty).
    A sample's steps are put together in one row, as its generated text is.
    """
    said = steps.where("position is not null").groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("position", F.coalesce("token", F.lit("")).alias("token")))).alias("s"))
    found = _placed(said, steps.schema["position"].dataType, marker)
    return found.select("sample_id", F.coalesce("position", (F.element_at("s.position", -1) + 1).cast(steps.schema["position"].dataType)).alias("position"), "head")


def _placed(said: DataFrame, kind, marker: str) -> DataFrame:
    """``position`` (null without a marker before a token) and ``head`` for rows with ``s``, the list of positions and tokens."""
    said = said.withColumn("text", F.array_join("s.token", ""))
    back = F.locate(marker[::-1], F.reverse("text"))  # from the end, 1 for the last character
    said = said.withColumn("end", F.length("text") - F.when(back > 0, back - 1).otherwise(0))

    def walk(a, x):
        to = a["at"] + F.length(x["token"])
        here = a["position"].isNull() & (to > a["end"])
        return F.struct(to.alias("at"), a["end"].alias("end"), F.when(here, x["position"]).otherwise(a["position"]).alias("position"), F.when(here, a["end"] - a["at"]).otherwise(a["inside"]).alias("inside"))

    # the end goes with the fold, so it is found once a sample, not once a token
    zero = F.struct(F.lit(0).alias("at"), F.col("end"), F.lit(None).cast(kind).alias("position"), F.lit(0).alias("inside"))
    found = said.withColumns({"marker": F.lit(marker), "f": F.aggregate("s", zero, walk)})
    head = F.when(F.col("f.inside") > 0, F.expr("right(marker, f.inside)")).otherwise("")
    return found.withColumns({"position": F.col("f.position"), "head": head}).drop("text", "end", "marker", "f")


def _finite(logits: DataFrame) -> DataFrame:
    return logits.where(F.col("logit").isNotNull() & ~F.isnan("logit") & (F.abs("logit") < float("inf")))


def answer_probabilities(steps: DataFrame, logits: DataFrame, options: DataFrame, marker: str = MARKER) -> DataFrame:
    """``sample_id, opt, p``: softmax over the options' tokens where the answer is drawn; uniform, if none of them was stored."""
    asked = options.select("sample_id", "opt").distinct().join(answer_positions(steps, marker), "sample_id", "left").withColumn("token", F.concat("head", "opt"))
    found = _finite(logits).select("sample_id", "position", "token", "logit").join(small(asked.where("token is not null")), ["sample_id", "position", "token"])
    best = found.groupBy("sample_id", "opt").agg(F.max("logit").cast("double").alias("logit"))
    both = asked.select("sample_id", "opt").join(best, ["sample_id", "opt"], "left").withColumn("logit", F.coalesce("logit", F.lit(MISSING)))
    w = Window.partitionBy("sample_id")
    e = both.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w)))
    return e.select("sample_id", "opt", F.round(F.col("e") / F.sum("e").over(w), 9).alias("p"))


def best_probabilities(logits: DataFrame, options: DataFrame) -> DataFrame:
    """``sample_id, opt, p``: softmax over the stored vocabulary at each position, the best of each option over all positions, renormalised; uniform, if none was stored.

    A window holds the vocabulary at one position; what is left of it for the exchange by sample is the options only.
    """
    at = Window.partitionBy("sample_id", "position")
    once = _finite(logits).groupBy("sample_id", "position", "token").agg(F.max("logit").cast("double").alias("logit"))
    e = once.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(at)))
    p = e.withColumn("p", F.col("e") / F.sum("e").over(at)).select("sample_id", F.col("token").alias("opt"), "p")
    asked = options.select("sample_id", "opt").distinct()
    found = p.join(small(asked), ["sample_id", "opt"]).groupBy("sample_id", "opt").agg(F.max("p").alias("p"))
    return fusion.max_over_positions(asked.join(found, ["sample_id", "opt"], "left"))


def answers_of(outputs: DataFrame, marker: str = MARKER) -> DataFrame:
    """As ``answer_probabilities`` for rows ``(sample_id, tokens array<string>, logits array<array<struct<token, logit>>>, options array<string>)``: a list for each position, and each sample in its own row."""
    said = outputs.withColumn("s", F.transform("tokens", lambda x, i: F.struct(i.alias("position"), F.coalesce(x, F.lit("")).alias("token"))))
    found = _placed(said, "int", marker)
    found = found.select("sample_id", "head", F.array_distinct("options").alias("options"), F.get("logits", F.coalesce("position", F.size("tokens"))).alias("top"))
    finite = lambda x: x["logit"].isNotNull() & ~F.isnan(x["logit"]) & (F.abs(x["logit"]) < float("inf"))
    best = lambda o: F.array_max(F.transform(F.filter("top", lambda x: (x["token"] == F.concat("head", o)) & finite(x)), lambda x: x["logit"].cast("double")))
    told = found.withColumn("logits", F.transform("options", lambda o: F.coalesce(best(o), F.lit(MISSING))))
    each = told.select("sample_id", F.explode(F.arrays_zip("options", fusion.softmax(F.col("logits")).alias("p"))).alias("x"))
    return each.select("sample_id", F.col("x.options").alias("opt"), F.round("x.p", 9).alias("p"))


def _best_of_rows(shared):
    """For a batch of positions the best probability of each sample and option."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = shared.value
        for batch in batches:
            top = batch.column(1)
            row = np.repeat(np.arange(len(batch)), top.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            token, logit = top.flatten().flatten()
            code = pc.index_in(token, value_set=options).fill_null(-1).to_numpy(zero_copy_only=False)
            x = logit.cast(pa.float64()).to_numpy(zero_copy_only=False)
            good = np.isfinite(x)
            row, code, x, token = row[good], code[good], x[good], token.filter(pa.array(good))
            # of a token that a position holds twice the best counts; told by the token only where one is held twice
            same = pc.dictionary_encode(token).indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            key = row * (same.max(initial=0) + 1) + same
            if len(np.unique(key)) < len(key):
                order = np.lexsort((-x, key))
                order = np.sort(order[np.concatenate([[True], key[order][1:] != key[order][:-1]])])
                row, code, x = row[order], code[order], x[order]
            if not len(row):
                continue
            begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            sizes = np.diff(np.append(begins, len(row)))
            e = np.exp(x - np.repeat(np.maximum.reduceat(x, begins), sizes))
            p = e / np.repeat(np.add.reduceat(e, begins), sizes)
            at = code >= 0
            samples = batch.column(0).dictionary_encode()
            key = samples.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row[at]] * max(1, len(options)) + code[at]
            best = np.full(len(samples.dictionary) * max(1, len(options)), -1.0)
            np.maximum.at(best, key, p[at])
            key = np.flatnonzero(best >= 0)
            yield pa.RecordBatch.from_arrays([samples.dictionary.take(pa.array(key // max(1, len(options)))), options.take(pa.array(key % max(1, len(options)))), pa.array(best[key])], names=["sample_id", "opt", "p"])

    return run


def best_of(logits: DataFrame, options: DataFrame) -> DataFrame:
    """As ``best_probabilities`` for rows ``(sample_id, position, top array<struct<token, logit>>)``, one for each position: what a task hands on are its samples' options."""
    names = options.select("opt").distinct()
    asked = options.select("sample_id", "opt").distinct()
    if names.limit(MOST_OPTIONS + 1).count() > MOST_OPTIONS:
        return best_probabilities(logits.select("sample_id", "position", F.explode("top").alias("x")).select("sample_id", "position", "x.*"), options)
    shared = logits.sparkSession.sparkContext.broadcast(names.where("opt is not null").toArrow().column("opt").combine_chunks())
    kinds = [logits.schema["sample_id"].dataType.simpleString(), "string"]
    rows = logits.where("sample_id is not null").select("sample_id", F.transform("top", lambda x: F.struct(x["token"].alias("token"), x["logit"].cast("double").alias("logit"))).alias("top") if logits.schema["top"].dataType.elementType.fieldNames() != ["token", "logit"] else "top")
    p = rows.mapInArrow(_best_of_rows(shared), f"sample_id {kinds[0]}, opt {kinds[1]}, p double").groupBy("sample_id", "opt").agg(F.max("p").alias("p"))
    return fusion.max_over_positions(asked.join(p, ["sample_id", "opt"], "left"))
