"""Operator 12: whitening of embeddings by an exact mean and a second pass for the covariance.

1. Tasks sum the integer vectors x = floor(scale * c) + offset exactly (two halves of 64-bit sums, Python integers where they meet).
2. Tasks sum the outer products of x - S/n by one matrix product a batch; ``treeAggregate`` merges the d x d sums (8 d^2 bytes each).
3. The driver takes LAPACK's symmetric eigenvectors of the d x d covariance and broadcasts the projection (8 d ``components`` bytes).
4. A third pass measures the covariance of the whitened vectors against the identity; a fourth returns the rows.

Nothing that grows with the rows reaches the driver; d is bounded by ``MOST_DIMENSIONS``.

Edge cases: vectors that are null, empty, or hold null or non-finite entries take no part, nor do vectors of another dimension than the commonest (ties: the
larger); null and repeated ids and equal vectors are rows each, and all count in the fit; x beyond 64 bits is the nearest 64-bit number; a
``deviation`` beyond 64 bits is the largest one, ``deviation_digits`` holds the exact number always; a component without variance (fewer
different rows than components, constant dimensions) has ``whitened`` null and no part in ``identity_error``, which is null if no component has any; ``explained`` is
null if no dimension varies; an empty table gives an empty one; other columns are dropped.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, COMPONENTS, MOST_DIMENSIONS = 1024, 100_000, 8, 4096
#: Values of a batch that one matrix product takes.
VALUES = 1 << 20
LIMIT = 2**63 - 1
OUT = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"


def integers(c: np.ndarray, scale: int, offset: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = np.floor(scale * c.astype(np.float64))
    out = np.clip(y, -(2.0**62), 2.0**62).astype(np.int64) + offset
    return np.where(y >= 2.0**62, LIMIT, np.where(y <= -(2.0**62), -LIMIT, out)) if np.abs(y).max(initial=0) >= 2.0**62 else out


def blocks(batch: pa.RecordBatch, dim: int | None, scale: int, offset: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x) for rows of one dimension, or of each, in blocks of bounded size."""
    col = batch.column(batch.schema.get_field_index("embedding"))
    size = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(size) - size
    values = col.flatten().to_numpy(zero_copy_only=False)
    for d in [dim] if dim else np.unique(size).tolist():
        rows, step = np.flatnonzero(size == d), max(1, VALUES // d)
        for i in range(0, len(rows), step):
            at = rows[i : i + step]
            yield at, integers(values[first[at][:, None] + np.arange(d)], scale, offset)


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers; blocks have fewer than 2**31 rows."""
    return (x >> 31).sum(axis=0).astype(object) * 2**31 + (x & (2**31 - 1)).sum(axis=0).astype(object)


def merged(df: DataFrame, per_task, zero, add):
    """``per_task(batches)`` of every partition, added up over a tree of tasks."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(per_task(batches))], pa.binary())], names=["part"])

    parts = df.mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    return parts.treeAggregate(zero, add, add)


def centred(x: np.ndarray, n: int, sums: np.ndarray, wide: bool) -> np.ndarray:
    """n * x - S, exact: Python integers where 64 bits may not do."""
    return n * x.astype(object) - sums if wide else n * x - sums


def squares(d: np.ndarray, wide: bool) -> list[int]:
    if not wide and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2.0**62:
        return (d * d).sum(axis=1).tolist()
    if not wide:  # halves, so that no product leaves 64 bits: |d| < 2**62
        hi, lo = d >> 31, d & (2**31 - 1)
        return ((hi * hi).astype(object) * 2**62 + (hi * lo).astype(object) * 2**32 + (lo * lo).astype(object)).sum(axis=1).tolist()
    return (d * d).sum(axis=1).tolist()


def _add_sums(a: dict, b: dict) -> dict:
    out = dict(a)
    for dim, (n, s, most) in b.items():
        m, t, top = out.get(dim, (0, 0, 0))
        out[dim] = (m + n, t + s, max(top, most))
    return out


def _add(a, b):
    return b if a is None else a if b is None else a + b


def fit(clean: DataFrame, scale: int, offset: int, components: int) -> dict | None:
    """n, dim, sums, projection (dim x components), eigenvalues and trace; None for no rows."""

    def sums(batches):
        out: dict = {}
        for batch in batches:
            for _, x in blocks(batch, None, scale, offset):
                out = _add_sums(out, {x.shape[1]: (len(x), exact_sums(x), int(np.abs(x).max()))})
        return out

    found = merged(clean, sums, {}, _add_sums)
    if not found:
        return None
    dim = max(found, key=lambda d: (found[d][0], d))
    if dim > MOST_DIMENSIONS:
        raise ValueError(f"{dim} dimensions; a covariance of more than {MOST_DIMENSIONS} is not kept in one process")
    n, total, most = found[dim]
    wide = 2 * n * most >= 2**62
    total = total if wide else total.astype(np.int64)

    def outer(batches):
        out = np.zeros((dim, dim))
        for batch in batches:
            for _, x in blocks(batch, dim, scale, offset):
                d = (centred(x, n, total, wide) / n).astype(np.float64)
                out += d.T @ d
        return out

    cov = merged(clean, outer, None, _add) / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:components]
    values, vectors = values[order], vectors[:, order]
    live = values > dim * np.finfo(float).eps * max(values[0], 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        projection = np.where(live, vectors / np.sqrt(np.where(live, values, 1)), 0.0)
    return {"n": n, "dim": dim, "sums": total, "wide": wide, "values": values, "live": live, "projection": projection, "trace": float(np.trace(cov))}


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """A row for each vector of ``vectors (vec_id, embedding)`` and component, as ``OUT`` says."""
    spark = vectors.sparkSession
    schema = OUT.format(id=dict(vectors.dtypes)["vec_id"])
    clean = vectors.select("vec_id", "embedding").where("size(embedding) > 0")
    clean = clean.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))))
    model = fit(clean, scale, offset, components)
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def rows(batch):
        m = shared.value
        for at, x in blocks(batch, m["dim"], scale, offset):
            d = centred(x, m["n"], m["sums"], m["wide"])
            yield at, d, (d / m["n"]).astype(np.float64) @ m["projection"]

    live, n, wide = model["live"], model["n"], model["wide"]
    k = len(live)

    def gram(batches):
        out = np.zeros((k, k))
        for batch in batches:
            for _, _, w in rows(batch):
                out += w.T @ w
        return out

    off_by = merged(clean, gram, None, _add) / n - np.eye(k)
    error = float(np.abs(off_by[live][:, live]).max()) if live.any() else None
    explained = [float(v) / model["trace"] if model["trace"] > 0 else None for v in np.maximum(model["values"], 0)]

    def out(batches):
        for batch in batches:
            for at, d, w in rows(batch):
                digits = squares(d, wide)
                ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                columns = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(k * len(at), n)), pa.array(np.repeat(np.array([min(x, LIMIT) for x in digits], np.int64), k)),
                    pa.array(w.ravel(), mask=np.tile(~live, len(at))), pa.array(explained * len(at), pa.float64()), pa.array([error] * (k * len(at)), pa.float64()), pa.array([str(x) for x in digits]).take(pa.array(np.repeat(np.arange(len(at)), k))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in schema.split(", ")])

    return clean.mapInArrow(out, schema)
