"""Operator 4: SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two halves; of two fingerprints at most 3 bits apart one half differs by one bit at
most.  Each half is indexed as it is (difference 0) and with each one of its bits replaced by a wildcard
(difference 1).  So that a bucket stays small even among thousands of near copies, every key also fixes a
part of the other half, in the same way: with at most ``radius`` bits left for it, one of its pieces is equal.  The rows are
joined by key equality (an exchange and a sort), the members of a bucket are verified by the number of
differing bits, and a bucket gives spanning links only, never all pairs.  Equal fingerprints are one class from the start.

Edge cases: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle
are one shingle; null ids are rows without a say in ``component_id`` (null only if no member has an id);
repeated rows are members of one class; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, partitions, slices

SHINGLE, RADIUS, SEED = 3, 2, 42


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 values of the word shingles; A-Z are lower-cased, words split at ASCII space; fewer words are one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    stop = (ends[shingle - 1 :] - 1).tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, map(flat.__getitem__, map(slice, begin, stop)), repeat(SEED)), np.uint64, len(begin))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 values of the word shingles; zero without words."""
    h = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text = part.column(part.schema.names.index("text"))
                fp = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in text], np.uint64)
                rest = [i for i, k in enumerate(part.schema.names) if k != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), pa.array(fp.view(np.int64))], names=[*(part.schema.names[i] for i in rest), "fp"])

    return run


def _halves(radius: int) -> list[tuple[int, list[int]]]:
    """(half, masks of fixed bits) for each signature kind: mask over the 64 bits, and which bit is the wildcard (-1: none)."""
    kinds = []
    for half in (0, 1):
        mine, other = 32 * half, 32 * (1 - half)
        for bit in range(-1, 32):
            left = radius - (bit >= 0)  # bits that may still differ in the other half
            pieces = left + 1
            cuts = [32 * i // pieces for i in range(pieces + 1)]
            own = ((1 << 32) - 1) & ~((1 << bit) if bit >= 0 else 0)
            for a, b in zip(cuts, cuts[1:], strict=False):
                kinds.append((mine + bit if bit >= 0 else -1, (own << mine) | (((1 << (b - a)) - 1) << (a + other))))
    return kinds


def variants(radius: int):
    kinds = _halves(radius)
    salt = [np.uint64(int.from_bytes(xxhash.xxh64_digest(str(k).encode(), 1), "little")) for k in range(len(kinds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .rolling import mix

        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                fp = batch.column(0)[start : start + 4096].to_numpy().view(np.uint64)
                keys = np.stack([mix((fp & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15) + s) for (_, mask), s in zip(kinds, salt, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(fp, len(kinds)).view(np.int64))], names=["key", "fp"])

    return run


def _links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the graph on the sorted distinct fingerprints of one bucket."""
    n = len(fp)
    left = np.arange(n)
    a, b = [], []
    todo = list(range(n))
    unseen = np.ones(n, bool)
    while todo:
        root = todo.pop()
        if not unseen[root]:
            continue
        unseen[root] = False
        stack = [root]
        while stack:
            x = stack.pop()
            rest = left[unseen]
            near = rest[np.bitwise_count(fp[rest] ^ fp[x]) <= radius]
            unseen[near] = False
            a.extend([fp[x]] * len(near))
            b.extend(fp[near])
            stack.extend(near.tolist())
    return np.array(a, np.uint64), np.array(b, np.uint64)


def verify(radius: int):
    """Over rows sorted by key: members of a bucket within ``radius`` bits, as spanning links."""

    def bucketed(key, fp):
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(cut, len(key)))
        two = cut[size == 2]
        d = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
        a, b = [fp[two][d]], [fp[two + 1][d]]
        for i, n in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            x, y = _links(np.unique(fp[i : i + n]), radius)
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            done = int(np.searchsorted(key, key[-1])) if key[0] <= key[-1] else 0
            if done:
                yield bucketed(key[:done], fp[:done])
                key, fp = key[done:], fp[done:]
        if len(key):
            yield bucketed(key, fp)

    return run


def components(fps: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """``(fp, root)`` for the fingerprints that have a link; ``fps`` are distinct."""
    if not 1 <= radius <= 3:
        raise ValueError("two halves with one wildcard cover 1 to 3 differing bits")
    n = partitions(fps.sparkSession, fps.count() * len(_halves(radius)))
    keys = fps.select("fp").repartition(n, "fp").mapInArrow(variants(radius), "key long, fp long")
    links = keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(verify(radius), "a long, b long")
    return connected_components(links, scratch).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, radius: int = RADIUS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``carry``, ``fp long, component_id`` of every row."""
    base = docs.select("doc_id", *carry, "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "text")
    prints = scratch.keep(base.withColumn("text", F.col("text").cast("binary")).mapInArrow(fingerprints(shingle), f"{types}, fp long"), "fingerprints")
    classes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = classes.join(components(classes, scratch, radius), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = scratch.keep(roots, "roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.keep(roots.join(least, "root").select("fp", "component_id"), "components")
    scratch.drop(classes, roots)
    return prints.join(named, "fp")


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple], shingle: int = SHINGLE, radius: int = RADIUS) -> list[tuple]:
    """All pairs, for small fixtures."""
    fps = []
    for i, t in rows:
        words = (t or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
        h = [xxhash.xxh64_intdigest(s, SEED) for s in shingles]
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0))
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(fps)):
        for y in range(x):
            if bin(fps[x][1] ^ fps[y][1]).count("1") <= radius:
                root[find(x)] = find(y)
    least: dict[int, int] = {}
    for x, (i, _) in enumerate(fps):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return [(i, f"{f:016x}", least.get(find(x))) for x, (i, f) in enumerate(fps)]
