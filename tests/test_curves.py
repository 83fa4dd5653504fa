"""Rejection curves where most rows share a value."""

import random

import numpy as np
from pyspark.sql import functions as F

from calibrant.operators import curves
from calibrant.sources.tables import Workspace


def test_most_rows_share_a_value(spark):
    """AUROC and AURAC against plain loops; no range holds over twice the mean."""
    r = random.Random(4)
    rows = [(i, 0.999 if r.random() < 0.9 else round(r.random(), 3), r.randrange(2)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "sample_id long, p double, label int").repartition(8)
    workspace = Workspace(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    try:
        got = curves.aurac(df, ["sample_id"], workspace=workspace).first()["aurac"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    labels = np.array([x[2] for x in sorted(rows, key=lambda x: (-x[1], x[0]))])
    acc = np.cumsum(labels) / np.arange(1, len(labels) + 1)
    at = [acc[max(1, round((1.0 - j * (1.0 / 1000)) * len(labels))) - 1] for j in range(1001)]
    assert abs(got - sum((a + b) / 2 * 0.001 for a, b in zip(at, at[1:], strict=False))) < 2e-6
    sizes = [x["count"] for x in spark.read.parquet(f"{workspace.root}/aurac").groupBy("__part").agg(F.count(F.lit(1)).alias("count")).collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    pos, neg = sorted(x[1] for x in rows if x[2]), np.array(sorted(x[1] for x in rows if not x[2]))
    wins = sum(np.searchsorted(neg, p, "left") + np.searchsorted(neg, p, "right") for p in pos) / 2
    assert abs(curves.auroc(df).first()["auroc"] - wins / (len(pos) * len(neg))) < 1e-8
