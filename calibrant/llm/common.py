"""Shared plumbing: scratch tables in the cluster's shared folder, key columns, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slices of an Arrow batch that one numpy pass handles; a longer document is a slice by itself.
SLICE_BYTES = 1 << 19
#: Rows of an Arrow batch between the JVM and Python: both sides hold whole batches, of whole texts.
BATCH_ROWS = 2000
#: While a table is written: small batches; shuffles that the table replaces are deleted; partitions, and so files, of about 16 MB
#: instead of as many as there are cores.
WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in a local session that names none (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="calibrant-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Parquet tables that cut lineage.  They lie in the shared folder, so a lost executor takes none along.

    A result still reads its last tables; ``Scratch.sweep`` deletes them when the caller has written it.
    """

    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        Scratch.opened.append(self)
        self.root = f"{shared_root(spark)}/calibrant-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    @contextmanager
    def writing(self) -> Iterator[None]:
        """The settings of ``WRITING``; the session's own come back afterwards."""
        old = {k: self.spark.conf.get(k, None) for k in WRITING}
        for k, v in WRITING.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in old.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with self.writing():
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._calibrant_path = path
        self.release()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more, and let Spark clean the shuffles behind them."""
        jvm = self.spark._jvm
        self.release()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._calibrant_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    @classmethod
    def sweep(cls, since: int = 0) -> None:
        """Delete all that the scratch folders opened after the first ``since`` still hold."""
        for old in cls.opened[since:]:
            path = old.spark._jvm.org.apache.hadoop.fs.Path(old.root)
            path.getFileSystem(old.spark._jsc.hadoopConfiguration()).delete(path, True)
        del cls.opened[since:]

    def release(self) -> None:
        """Shuffle files go when the driver's JVM finds that no plan refers to them."""
        gc.collect()
        self.spark._jvm.System.gc()


def partitions(spark: SparkSession, rows: int, each: int = 4_000_000) -> int:
    """Partitions of an exchange of so many narrow rows: as the session says, more where a task would hold over ``each``."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def tidy(run: Callable) -> Callable:
    """``run`` (for mapInArrow), which hands memory back when its task ends.

    A Python worker serves many tasks and stages; what its allocators keep of one would count against the executor in the next.
    """

    def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return with_end


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row slices whose text is at most ``limit`` bytes (or one row)."""
    text = batch.column(batch.schema.get_field_index(column))
    n = batch.num_rows
    if not n:
        return
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    import numpy as np

    off = np.frombuffer(text.buffers()[1], dtype=np.int64 if wide else np.int32)[text.offset : text.offset + n + 1]
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = min(j, n)


def flat(text: pa.Array):
    """(bytes as uint8, offsets from 0) of a string or binary Arrow array, without copying; nulls are empty."""
    import numpy as np

    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    n = len(text)
    bufs = text.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8)[off[0] : off[-1]] if bufs[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def overlapping(data, off, reach: int, limit: int = SLICE_BYTES):
    """A slice as it is, or the pieces of a single long document: ``(data, off, base)``, ``limit`` bytes and ``reach`` more of what follows."""
    import numpy as np

    if len(off) != 2 or len(data) <= limit + reach:
        yield data, off, 0
        return
    for base in range(0, len(data) - reach, limit):
        part = data[base : base + limit + reach]
        yield part, np.array([0, len(part)]), base


def doc_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``kd, kt``: a key of the document that later joins can rely on, null ids and repeated ids included."""
    return df.withColumns({"kd": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), "kt": F.xxhash64(F.lit(0), F.coalesce(F.col(text_col), F.lit("")))})


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` with the smallest node reachable over undirected ``edges (a, b)``.

    Every round hooks each node to the smallest label among its neighbours and then shortens the paths
    (label of the label), so chains halve.  Only aggregates that combine before the shuffle and equi-joins that
    AQE can split are used: a hub with a third of all edges is never gathered in one task.  Labels of a
    round are a written table; what reaches the driver is one count.
    """
    both = edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
    both = scratch.keep(both.distinct(), "cc-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "cc-labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        # the roots themselves are hooked too: the smallest label seen by any member of the old tree
        hook = labels.join(near, "node").groupBy(F.col("root").alias("node")).agg(F.min("near").alias("hook"))
        step = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        step = step.join(hook, "node", "left").select("node", "was", F.least("root", "hook").alias("root"))
        step = scratch.keep(step, "cc-step")
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        out = step.join(jump, "root", "left").select("node", F.least("root", "up").alias("root"), "was")
        out = scratch.keep(out, "cc-labels")
        changed = out.where("root <> was").limit(1).count()
        scratch.drop(labels, step)
        labels = out.drop("was")
        labels._calibrant_path = out._calibrant_path
        if not changed:
            scratch.drop(both)
            return labels
    raise RuntimeError("components did not converge")
