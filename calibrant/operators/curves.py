"""AUROC and area under the rejection-accuracy curve over pooled option rows ``(p, label)``, p from 0 to 1.

AUROC runs through the distinct values cell by cell (see ``running``); AURAC through all rows by sampled ranges, as most rows may share a value (see ``order``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibrant.operators.order import preceding_sums
from calibrant.operators.running import running
from calibrant.sources.tables import Workspace


def auroc(rows: DataFrame) -> DataFrame:
    """Mann-Whitney with mid-ranks; null if one class is missing."""
    by = rows.groupBy("p").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    ranked = running(by, "p", {"upto": F.col("n")})
    mid = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    s = ranked.withColumn("r", F.col("pos") * mid).agg(F.sum("r").alias("r"), F.sum("pos").alias("np"), F.sum("n").alias("n"))
    np_, nn = F.col("np").cast("double"), (F.col("n") - F.col("np")).cast("double")
    return s.select(F.round(F.try_divide(F.col("r") - np_ * (np_ + 1) / 2, np_ * nn), 9).alias("auroc"))


def aurac(rows: DataFrame, order: list[str], steps: int = 1000, workspace: Workspace | None = None) -> DataFrame:
    """Trapezoid of the accuracy of the most confident (1 - r) n rows, r = 0 .. 1 in ``steps``; ties by ``order``."""
    told = rows.select((-F.col("p")).alias("__low"), *[c for c in order if c != "label"], "label", F.lit(1).alias("__one"))
    run = preceding_sums(told, [], ["__low", *order], {"k": "__one", "hits": "label"}, workspace or Workspace(rows.sparkSession), "aurac")
    run = run.select((F.col("k") + 1).alias("k"), ((F.col("hits") + F.col("label")) / (F.col("k") + 1)).alias("acc"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    grid = rows.sparkSession.range(steps + 1).select((F.col("id") * (1.0 / steps)).alias("r")).join(F.broadcast(n), F.lit(True))
    keep = grid.select("r", F.greatest(F.lit(1), F.bround((1.0 - F.col("r")) * F.col("n"), 0).cast("long")).alias("k"))
    at = run.join(F.broadcast(keep), "k")  # at most steps + 1 rows are left
    back = Window.orderBy("r")
    area = (F.col("r") - F.lag("r").over(back)) * (F.col("acc") + F.lag("acc").over(back)) / 2
    return at.withColumn("a", area).agg(F.round(F.sum("a"), 6).alias("aurac"))
