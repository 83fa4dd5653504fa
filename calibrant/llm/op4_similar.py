"""Operator 4 at a similarity: deletion-variant signatures over wide sketches of word shingles.

SimHash bits cannot index a similarity of 0.8: such texts differ in about 10 of 64 bits, so a segment that differs in at most
one bit has under 13 bits and its buckets grow with the corpus.  The same signatures are built here on coordinates that are
wide: ``BITS`` min-hashes of a text's set of shingles.  The first ``SEGMENTS * SEGMENT`` are the index: each segment is
indexed with each one of its coordinates replaced by a wildcard, so texts meet where a segment differs in at most one
coordinate (at similarity 0.8 with a chance of 0.998).  One bit of every min-hash makes the sketch that verifies: texts of
similarity s differ in (1 - s) / 2 of its bits (standard deviation 0.013 of similarity).  Sketches four deviations under the limit
link, those four deviations over it do not; members with a neighbour in between are compared once more by the exact Jaccard
similarity of their shingles.

Keys are exchanged with a class number only; buckets with the same members become one before sketches are joined to them.
A bucket gives spanning links, never all pairs.  One of more than ``BLOCK`` members is dealt into blocks, and every two blocks meet as
a bucket of their own, so no link is missed and memory is bounded.

Edge cases: null and empty texts are one class; fewer words than a shingle are one shingle; null ids are
rows without a say in ``component_id``; repeated rows are members of one class; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, partitions, slices, tidy
from .op4_simhash import shingle_hashes
from .rolling import mix

BITS, SEGMENTS, SEGMENT = 2048, 6, 6
SHINGLE, SIMILARITY = 5, 0.8
BLOCK = 16_384
#: Sketches this far from the limit decide by themselves (wrong once in 30,000 pairs at the limit); the others are compared exactly.
DEVIATIONS = 4
#: Shingles kept decoded while a bucket is compared.
KNOWN = 1 << 22
_RNG = np.random.default_rng(44)
MULTIPLY = _RNG.integers(0, 1 << 31, BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _RNG.integers(0, 1 << 32, BITS, dtype=np.uint32)
INDEXED = SEGMENTS * SEGMENT


def limit(similarity: float, deviations: float = 1) -> int:
    share = (1 - similarity) / 2
    return int(BITS * share + deviations * (BITS * share * (1 - share)) ** 0.5)


def min_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray | None:
    h = shingle_hashes(text, shingle)
    if not len(h):
        return None
    h = np.unique(h.astype(np.uint32))
    least = np.full(BITS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 2048):
        part = h[None, i : i + 2048]
        for j in range(0, BITS, 64):
            value = MULTIPLY[j : j + 64, None] * part
            value += ADD[j : j + 64, None]
            np.minimum(least[j : j + 64], value.min(axis=1), out=least[j : j + 64])
    return least


def sketch(least: np.ndarray) -> bytes:
    return np.packbits(((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(bool)).tobytes()


def signatures(shingle: int):
    """``kt``, the indexed coordinates and the sketch; null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names = part.schema.names
                found = [min_hashes(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in part.column(names.index("text"))]
                rest = [k for k in names if k != "text"]
                sig = pa.array([None if m is None else m[:INDEXED].tobytes() + sketch(m) for m in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(k)) for k in rest), sig], names=[*rest, "sig"])

    return run


def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key for each segment and wildcard: the other coordinates of the segment."""
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            c = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in part.column(1)), np.uint32).reshape(part.num_rows, INDEXED).astype(np.uint64)
            keys = []
            for s in range(SEGMENTS):
                for wild in range(SEGMENT):
                    key = np.full(part.num_rows, s * SEGMENT + wild, np.uint64)
                    for k in range(SEGMENT):
                        if k != wild:
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + c[:, s * SEGMENT + k])
                    keys.append(key)
            kt = part.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(kt, INDEXED))], names=["key", "kt"])


def whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """Numpy columns of rows sorted by the first one, never cut inside a group."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy() for i in range(columns)]
        at = int(np.searchsorted(now[0], now[0][-1]))
        if at or (held and held[-1][0][-1] != now[0][0]):
            out = [np.concatenate([h[i] for h in held] + [now[i][:at]]) for i in range(columns)]
            held = []
            if len(out[0]):
                yield out
        held.append([x[at:] for x in now])
    if held:
        yield [np.concatenate([h[i] for h in held]) for i in range(columns)]


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of the buckets of two and more; a bucket is named by its members, so equal ones coincide."""
    for key, kt in whole_groups(batches, 2):
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(cut, len(key)))
        with np.errstate(over="ignore"):
            name = mix(np.add.reduceat(mix(kt.view(np.uint64)), cut) + size.astype(np.uint64))
        many = np.repeat(size > 1, size)
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[many].view(np.int64)), pa.array(kt[many])], names=["bucket", "kt"])


def spanning(bits: np.ndarray, linked) -> tuple[list, list, np.ndarray]:
    """Spanning links (positions) and the component of each member; ``linked(x, others)`` tells which of the others x links to."""
    a, b, component = [], [], np.zeros(len(bits), np.int64)
    unseen = np.arange(len(bits))
    while len(unseen):
        stack, unseen = [int(unseen[0])], unseen[1:]
        component[stack[0]] = label = stack[0]
        while stack and len(unseen):
            x = stack.pop()
            near = linked(x, unseen)
            hit = unseen[near].tolist()
            a += [x] * len(hit)
            b += hit
            component[hit] = label
            stack += hit
            unseen = unseen[~near]
    return a, b, component


def differing(bits: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits[others] ^ bits[x]).sum(axis=1, dtype=np.int64)


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Buckets of rows sorted by the first column."""
    name, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(0).to_numpy()
        cut = np.flatnonzero(np.append(True, names[1:] != names[:-1])).tolist()
        for i, j in zip(cut, [*cut[1:], batch.num_rows], strict=True):
            if held and name != names[i]:
                yield name, pa.Table.from_batches(held)
                held = []
            name = int(names[i])
            held.append(batch.slice(i, j - i))
    if held:
        yield name, pa.Table.from_batches(held)


def sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in column), np.uint64).reshape(len(column), -1)


def verify(most: int, doubt: int | None = None):
    """Spanning links ``a, b`` of each bucket.  With ``doubt`` there is a third column, and rows where it is true name a
    bucket and a member that differs in at most ``doubt`` bits from a member of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in whole_buckets(batches):
            kt, bits = rows.column(1).to_numpy(), sketches(rows.column(2))
            a, b, component = spanning(bits, lambda x, others: differing(bits, x, others) <= most)  # noqa: B023
            columns, names = [kt[a], kt[b]], ["a", "b"]
            if doubt is not None:
                open_ = np.zeros(len(kt), bool)
                if (component != component[0]).any():
                    every = np.arange(len(kt))
                    for x in every:
                        open_[x] = ((differing(bits, x, every) <= doubt) & (component != component[x])).any()
                more = kt[open_]
                columns = [np.append(columns[0], np.full(len(more), bucket)), np.append(columns[1], more), np.append(np.zeros(len(a), bool), np.ones(len(more), bool))]
                names = [*names, "doubtful"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def verify_exactly(most: int, doubt: int, similarity: float, shingle: int):
    """Spanning links of each bucket, by Jaccard similarity where a sketch differs in more than ``most`` bits and at most ``doubt``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in whole_buckets(batches):
            kt, bits, text = rows.column(1).to_numpy(), sketches(rows.column(2)), rows.column(3)
            known: dict[int, np.ndarray] = {}

            def shingles(x: int) -> np.ndarray:
                if x not in known:  # noqa: B023
                    if sum(map(len, known.values())) > KNOWN:  # noqa: B023
                        known.clear()  # noqa: B023
                    known[x] = np.unique(shingle_hashes(text[x].as_buffer().to_pybytes(), shingle))  # noqa: B023
                return known[x]  # noqa: B023

            def linked(x: int, others: np.ndarray) -> np.ndarray:
                apart = differing(bits, x, others)  # noqa: B023
                near = apart <= most
                mine = shingles(x)
                for i in np.flatnonzero(~near & (apart <= doubt)).tolist():
                    other = shingles(int(others[i]))
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    near[i] = both >= similarity * (len(mine) + len(other) - both) - 1e-9
                return near

            a, b, _ = spanning(bits, linked)
            yield pa.RecordBatch.from_arrays([pa.array(kt[a]), pa.array(kt[b])], names=["a", "b"])

    return run


def split_large(members: DataFrame) -> DataFrame:
    """``bucket, kt`` where each bucket of over ``BLOCK`` members is dealt into blocks and replaced by all pairs of these."""
    large = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK).select("bucket", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(large, "bucket", "left").withColumn("mine", F.pmod(F.xxhash64("kt", F.lit(4)), F.coalesce("blocks", F.lit(1))).cast("int"))
    pairs = dealt.select("bucket", "kt", "blocks", "mine", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other")).where("blocks is null or mine <> other")
    name = F.when(F.col("blocks").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")))
    return pairs.select(name.alias("bucket"), "kt")


def similar(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, kt, component_id, component`` of every row: ``kt`` names the text, ``component`` the group (also where no member has an id)."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.xxhash64(F.lit(0), text).alias("kt"), text.cast("binary").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    rows = scratch.keep(base.mapInArrow(tidy(signatures(shingle)), f"doc_id {kind}, kt long, sig binary"), "signatures")
    classes = scratch.keep(rows.where("sig is not null").dropDuplicates(["kt"]).select("kt", "sig"), "classes")
    n = partitions(docs.sparkSession, classes.count() * INDEXED)
    head = classes.select("kt", F.substring("sig", 1, 4 * INDEXED).alias("c"))
    keys = head.mapInArrow(tidy(variants), "key long, kt long").repartition(n, "key").sortWithinPartitions("key")
    members = scratch.keep(keys.mapInArrow(tidy(shared), "bucket long, kt long").distinct(), "members")
    tail = classes.select("kt", F.substring("sig", 4 * INDEXED + 1, BITS // 8).alias("bits"))
    met = split_large(members).join(tail, "kt").select("bucket", "kt", "bits").repartition(n, "bucket").sortWithinPartitions("bucket", "kt")
    sure, doubt = limit(similarity, -DEVIATIONS), limit(similarity, DEVIATIONS)
    first = scratch.keep(met.mapInArrow(tidy(verify(sure, doubt)), "a long, b long, doubtful boolean").distinct(), "first-links")
    open_ = first.where("doubtful").select(F.col("a").alias("bucket"), F.col("b").alias("kt"))
    texts = base.select("kt", "text").join(open_.select("kt").distinct(), "kt", "left_semi").dropDuplicates(["kt"])
    near = open_.join(tail, "kt").join(texts, "kt").select("bucket", "kt", "bits", "text").repartition(n, "bucket").sortWithinPartitions("bucket", "kt")
    more = near.mapInArrow(tidy(verify_exactly(sure, doubt, similarity, shingle)), "a long, b long")
    links = scratch.keep(first.where("not doubtful").select("a", "b").union(more).distinct(), "links")
    scratch.drop(members, classes, first)
    roots = connected_components(links, scratch).select(F.col("node").alias("kt"), "root")
    # text -> group first, by pre-aggregated texts; then the least id of each group
    texts = rows.groupBy("kt").agg(F.min("doc_id").alias("least")).join(roots, "kt", "left").select("kt", "least", F.coalesce("root", "kt").alias("component"))
    texts = scratch.keep(texts, "texts")
    least = texts.groupBy("component").agg(F.min("least").alias("component_id"))
    named = texts.join(least, "component").select("kt", "component", "component_id")
    return rows.select("doc_id", "kt").join(named, "kt").select("doc_id", "kt", "component_id", "component")
