"""Split conformal prediction on long probability rows ``(split, sample_id, pos, opt, p, correct)``.

The threshold is the order statistic of 0-based index min(ceil((n + 1)(1 - alpha)), n - 1); arithmetic is DOUBLE.  Rows without
probabilities (skipped samples) count in the denominators of accuracy and coverage, not in mean set sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrant.operators.running import running

DIGITS = 9
SAMPLE = ["split", "sample_id"]


def softmax(rows: DataFrame, logit: str = "logit") -> DataFrame:
    w = Window.partitionBy(*SAMPLE)
    e = F.exp(F.col(logit) - F.max(logit).over(w))
    return rows.withColumn("e", e).withColumn("p", F.round(F.col("e") / F.sum("e").over(w), DIGITS)).drop("e")


def argmax(rows: DataFrame) -> DataFrame:
    """The first option of highest probability."""
    return rows.groupBy(*SAMPLE).agg(F.max(F.struct("p", (-F.col("pos")).alias("o"), "opt", "correct")).alias("m")).select(*SAMPLE, F.col("m.opt").alias("opt"), F.col("m.p").alias("p"), F.col("m.correct").alias("correct"))


def cumulative(rows: DataFrame) -> DataFrame:
    """Running mass by descending p (ties by position) and the rank."""
    w = Window.partitionBy(*SAMPLE).orderBy(F.desc("p"), "pos")
    return rows.withColumns({"cum": F.round(F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)), DIGITS), "rank": F.row_number().over(w)})


def scores(rows: DataFrame) -> DataFrame:
    """LAC and APS nonconformity of each sample."""
    at = F.when(F.col("correct"), F.col("p"))
    lac = F.round(1.0 - F.coalesce(F.max(at), F.lit(0.0)), DIGITS)
    aps = F.coalesce(F.min(F.when(F.col("correct"), F.col("cum"))), F.lit(1.0))
    return cumulative(rows).groupBy(*SAMPLE).agg(lac.alias("lac"), aps.alias("aps"))


def order_index(n: Column, alpha: Column) -> Column:
    return F.least(F.ceil((n + 1).cast("double") * (F.lit(1.0) - alpha)), n - 1)


def thresholds(sample_scores: DataFrame, alphas: list[float]) -> DataFrame:
    """``alpha, lac_threshold, aps_threshold``; 0.5 without calibration rows.

    Scores are counted by value first, so the order statistic is taken over a running count of distinct values.
    """
    spark = sample_scores.sparkSession
    grid = spark.createDataFrame([(float(a),) for a in alphas], "alpha double")
    n = sample_scores.agg(F.count(F.lit(1)).alias("n"))
    long = sample_scores.select(F.explode(F.array(F.struct(F.lit("lac").alias("kind"), F.col("lac").alias("s")), F.struct(F.lit("aps").alias("kind"), F.col("aps").alias("s")))).alias("x")).select("x.*")
    counted = long.groupBy("kind", "s").agg(F.count(F.lit(1)).alias("c"))
    below = running(counted, "s", {"upto": F.col("c")}, by=("kind",))
    want = grid.join(n, F.lit(True)).withColumn("i", order_index(F.col("n"), F.col("alpha")))
    hit = below.join(F.broadcast(want), F.col("upto") > F.col("i")).groupBy("alpha").agg(F.min(F.when(F.col("kind") == "lac", F.col("s"))).alias("lac"), F.min(F.when(F.col("kind") == "aps", F.col("s"))).alias("aps"))
    return grid.join(hit, "alpha", "left").select("alpha", F.coalesce("lac", F.lit(0.5)).alias("lac_threshold"), F.coalesce("aps", F.lit(0.5)).alias("aps_threshold"))


def in_sets(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Each option with ``in_lac`` and ``in_aps``: LAC keeps p >= 1 - t; APS the options before the one that crosses t, and always the first."""
    told = cumulative(rows).join(F.broadcast(limits), F.lit(True))
    return told.withColumns({"in_lac": F.col("p") >= F.round(1.0 - F.col("lac_threshold"), DIGITS), "in_aps": (F.col("cum") <= F.col("aps_threshold")) | (F.col("rank") == 1)})


def sets(rows: DataFrame, limits: DataFrame, kind: str) -> DataFrame:
    """``sample_id, options`` (joined in option order) ``, size``."""
    chosen = F.array_sort(F.collect_list(F.when(F.col(f"in_{kind}"), F.struct("pos", "opt"))))
    out = in_sets(rows, limits).groupBy("sample_id").agg(chosen.alias("s"))
    return out.select("sample_id", F.array_join(F.transform("s", lambda x: x["opt"]), ",").alias("options"), F.size("s").alias("size"))


def set_sizes(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """One row ``lac_set_sizes, aps_set_sizes``: the sizes of all evaluated samples in sample order."""
    size = lambda c: F.sum(F.col(c).cast("int")).cast("int")
    told = in_sets(rows, limits).groupBy("sample_id").agg(size("in_lac").alias("lac"), size("in_aps").alias("aps"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("sample_id", c))), lambda x: x[c])
    return told.agg(listed("lac").alias("lac_set_sizes"), listed("aps").alias("aps_set_sizes"))


def combined(metrics_row: DataFrame) -> DataFrame:
    """Coverage and set size as the mean of both kinds of sets."""
    mean = lambda a, b: F.round((F.col(a) + F.col(b)) / 2, 6)
    return metrics_row.select("accuracy", mean("lac_coverage", "aps_coverage").alias("coverage"), mean("lac_avg_set_size", "aps_avg_set_size").alias("set_size"))


class CustomMetrics:
    """Named scores of a sample: functions of its ``probs array<struct<pos, opt, p, correct>>`` in option order."""

    def __init__(self) -> None:
        self.known: dict = {}

    def add(self, name: str, score) -> None:
        self.known[name] = score

    def compute(self, rows: DataFrame) -> DataFrame:
        """A column ``name`` for each known metric, by sample."""
        probs = F.array_sort(F.collect_list(F.struct("pos", "opt", "p", "correct")))
        told = rows.groupBy(*SAMPLE).agg(probs.alias("probs"))
        return told.select(*SAMPLE, *[f(F.col("probs")).alias(name) for name, f in self.known.items()])


def normalised(samples: DataFrame, results: DataFrame) -> DataFrame:
    """Results with their samples' fields, joined by key: the sample's question, options and answers win, missing results have defaults."""
    out = samples.join(results.select("sample_id", "generated_response", "predicted_answer", "probs", *[c for c in results.columns if c not in (*samples.columns, "generated_response", "predicted_answer", "probs")]), "sample_id", "left")
    none = F.array().cast(results.schema["probs"].dataType)
    return out.withColumns({"generated_response": F.coalesce("generated_response", F.lit("")), "predicted_answer": F.coalesce("predicted_answer", F.lit("Unknown")), "probs": F.coalesce("probs", none)})


def metrics(rows: DataFrame, samples: DataFrame, limits: DataFrame) -> DataFrame:
    """Accuracy, coverage and mean set sizes; ``samples`` has every evaluated sample, skipped ones too."""
    hit = lambda c: F.max((F.col("correct") & F.col(c)).cast("int"))
    size = lambda c: F.sum(F.col(c).cast("int"))
    told = in_sets(rows, limits).groupBy(*SAMPLE).agg(hit("in_lac").alias("lac"), hit("in_aps").alias("aps"), size("in_lac").alias("nl"), size("in_aps").alias("na"), F.max(F.when((F.col("rank") == 1) & F.col("correct"), 1).otherwise(0)).alias("acc"))
    both = samples.select(*SAMPLE).join(told, SAMPLE, "left")
    n = F.count(F.lit(1))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.sum(F.coalesce(c, F.lit(0))), n), F.lit(0.0)), 6).alias
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias
    return both.agg(n.alias("total_samples"), share("acc")("accuracy"), share("lac")("lac_coverage"), share("aps")("aps_coverage"), mean("nl")("lac_avg_set_size"), mean("na")("aps_avg_set_size"))
