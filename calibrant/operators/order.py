"""Positions and running sums over an order, without a group in one task.

Rows are dealt by ranges of the whole order (Spark samples the splitters, so a value that most rows share is split by the keys behind it), the ranges' sums
are run up, a row for each range and group, and a window inside a range does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibrant.sources.tables import Workspace


def preceding(df: DataFrame, by: list[str], order: list[str], weight: str, out: str, workspace: Workspace, name: str = "ranges") -> DataFrame:
    """``df`` with ``out``: the sum of ``weight`` over the rows of the same ``by`` that come before in ``order``; nulls first, ties by all columns."""
    return preceding_sums(df, by, order, {out: weight}, workspace, name)


def preceding_sums(df: DataFrame, by: list[str], order: list[str], weights: dict[str, str], workspace: Workspace, name: str = "ranges") -> DataFrame:
    """As ``preceding``, for several sums ``{out: weight}`` over one order."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    tied = F.xxhash64(*[c for c in df.columns if kinds[c] != "map"])
    ranged = workspace.step(name, lambda: df.withColumn("__tie", tied).repartitionByRange(*by, *order, "__tie").withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "__part").agg(*[F.sum(w).alias(f"__sum_{out}") for out, w in weights.items()])
    up = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"__sum_{out}").over(up), F.lit(0)).alias(f"__before_{out}") for out in weights]
    sums = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__range"), *before)
    own = Window.partitionBy(*by, "__part").orderBy(*order, "__tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumns({f"__own_{out}": F.coalesce(F.sum(w).over(own), F.lit(0)) for out, w in weights.items()})
    same = F.col("__part") == F.col("__range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return inside.join(sums, same).select(*df.columns, *[(F.col(f"__before_{out}") + F.col(f"__own_{out}")).alias(out) for out in weights])
