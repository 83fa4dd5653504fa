"""Running sums over a global order without gathering all rows in one task.

Values are cut into ``CELLS`` equal cells of a known range.  Cells are summed (with a combiner) and their sums run up, at most ``CELLS`` rows for
each group; inside a cell a window does the rest.  So a task holds a cell, and only if values concentrate in one is it large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4096


def running(df: DataFrame, value: str, sums: dict[str, Column], by: tuple[str, ...] = (), ties: tuple[str, ...] = (), descending: bool = False, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``df`` with a column for each of ``sums``: the sum over all rows of the group ``by`` up to this one in the order of ``value`` and ``ties``."""
    cell = F.least(F.greatest(F.floor((F.col(value) - low) * (CELLS / (high - low))), F.lit(0)), F.lit(CELLS - 1)).cast("int")
    told = df.withColumns({"__cell": F.coalesce(-cell if descending else cell, F.lit(-CELLS)), **{f"__{k}": c for k, c in sums.items()}})
    keys = [*by, "__cell"]
    cells = told.groupBy(*keys).agg(*[F.sum(f"__{k}").alias(f"__all_{k}") for k in sums])
    up = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select(*keys, *[F.coalesce(F.sum(f"__all_{k}").over(up), F.lit(0)).alias(f"__before_{k}") for k in sums])
    order = [F.desc(value) if descending else F.asc(value), *ties]
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = told.join(F.broadcast(before), keys) if not by else told.join(before, keys)
    return out.select(*df.columns, *[(F.col(f"__before_{k}") + F.sum(f"__{k}").over(own)).alias(k) for k in sums])
