"""Operator 9: benchmark decontamination by latent semantic retrieval.

The benchmark is the query set, matched in blocks of ``ITEM_BLOCK`` items.  For a block, the corpus is one matrix: a row for each
passage of ``width`` words of every document (and of the items), a column for each word of the block's items; other words
have no part in any product with an item.  Words are compared in lower case and without ASCII punctuation.  Steps:

1. whole texts are read once, for all blocks; each document's words of the benchmark's vocabulary go, with their positions, to a written
   table, from which a block reads its own words;
2. document frequencies over all passages; words in over ``common`` of them have weight zero;
3. a randomised SVD: every task adds up A^T (A Omega) for a random words x rank matrix Omega, a Nystroem step on the driver
   (vocabulary x rank numbers, whatever the corpus) gives the leading right singular vectors.  Columns have unit length
   (LSI's "normal" weight times idf), so that words that occur together - an item and its copies - lead the spectrum;
4. overlapping passages are projected and compared with the items' passages by cosine, in matrix blocks.  This search is
   approximate (rank, cosine limit, words of weight zero), so an exact one stands beside it: every window that holds as many of
   an item's rarest words as step 5 asks for is a candidate, however common these words are;
5. candidates are verified on the words around the passage: half of the item's rarest words (they stand for its answer,
   which the table lacks) must occur, and the longest common subsequence must hold ``lcs`` of the item's words.

So no window that step 5 would accept is left out; ``cosine`` is 0 where all words of a passage are common.

Partial sums travel in chunks and are added while streaming, so no task holds more than one table.

Result: one row for each document and item that match (the best passage).  Edge cases: null or empty texts and items match
nothing; items of fewer than ``least_words`` words match where all their words follow each other (chance would match them
by subsequence), with ratios of 1; null ids are kept as they are; repeated rows give one row; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, flat, slices, tidy
from .rolling import ranges, word_names, words
from .textnorm import bare_words

WIDTH, STRIDE, ITEM_STRIDE = 32, 16, 8
COSINE, LCS, ANSWER, COMMON, LEAST_WORDS = 0.5, 0.6, 0.5, 0.01, 8
CHUNK, ITEM_BLOCK, RANKS = 64, 500, (32, 256)
#: Words in at most this many passages keep their weight whatever ``COMMON`` says (small corpora).
FLOOR = 20
#: Known words that are projected at once (times rank times 4 bytes); a batch is cut between documents.
PROJECTED = 1 << 15
SUMS = "chunk int, part binary"


def tokens(data: np.ndarray, off: np.ndarray):
    """Word hashes and each document's first word."""
    data, off = bare_words(data, off)
    start, end, first = words(data, off)
    return word_names(data, start, end), first


class Vocabulary:
    """Numbers of the words of a block of items; exact for 64-bit word hashes."""

    def __init__(self, hashes: np.ndarray):
        self.known = np.unique(hashes)
        self.jump = np.searchsorted(self.known, np.arange((1 << 16) + 1, dtype=np.uint64) << np.uint64(48))
        self.jump[-1] = len(self.known)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray):
        """(positions, numbers) of the known words of a stream."""
        at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        c = np.searchsorted(self.known, h[at])
        ok = self.known[np.minimum(c, len(self.known) - 1)] == h[at]
        return at[ok], c[ok].astype(np.int32)


def number_words(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = tokens(*flat(part.column(0)))
                at, c = vocabulary.find(h)
                cut = np.searchsorted(at, first)
                doc = np.repeat(np.arange(part.num_rows), np.diff(cut))
                pos = (at - first[doc]).astype(np.int32)
                yield pack(part.column(1), c, pos, cut)

    return run


def pack(ids: pa.Array, numbers: np.ndarray, at: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
    """``doc_id``, and the numbers and positions of each document's words as binary columns."""
    cuts = pa.array(cut.astype(np.int32) * 4, pa.int32())
    binary = lambda x: pa.Array.from_buffers(pa.binary(), len(ids), [None, cuts.buffers()[1], pa.py_buffer(np.ascontiguousarray(x))])
    return pa.RecordBatch.from_arrays([ids, binary(numbers), binary(at)], names=["doc_id", "words", "at"])


def of_block(own: np.ndarray):
    """Of the words of a written table those in ``own`` (sorted numbers), numbered anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = flat(batch.column(1))
            c, at = raw.view(np.int32), flat(batch.column(2))[0].view(np.int32)
            new = np.minimum(np.searchsorted(own, c), len(own) - 1)
            keep = own[new] == c
            yield pack(batch.column(0), new[keep].astype(np.int32), at[keep], np.append(0, np.cumsum(keep))[off // 4])

    return run


def passages(batch: pa.RecordBatch, live: np.ndarray, width: int):
    """Words of weight in the non-overlapping passages of a batch: (number, passage, first entry of each document, its passages)."""
    raw, off = flat(batch.column(1))
    c = raw.view(np.int32)
    pos = flat(batch.column(2))[0].view(np.int32)
    off = off // 4
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    count = np.zeros(len(off) - 1, np.int64)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        count[some] = pos[off[1:][some] - 1] // width + 1
    first = np.concatenate([[0], np.cumsum(count)])
    keep = np.flatnonzero(live[c])
    return c[keep], first[doc[keep]] + pos[keep] // width, first


def chunks(table: np.ndarray) -> pa.RecordBatch:
    n = -(-len(table) // CHUNK)
    rows = np.zeros((n * CHUNK, table.shape[1]))
    rows[: len(table)] = table
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array([r.tobytes() for r in rows.reshape(n, -1)], pa.binary())], names=["chunk", "part"])


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(part.as_buffer(), np.float64)
            total[c] = total[c] + x if c in total else x.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "part"])


def summed(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """The sum of the tasks' tables, chunk by chunk."""
    out = np.zeros((-(-rows // CHUNK) * CHUNK, columns))
    for r in parts.repartition(16, "chunk").mapInArrow(add_up, SUMS).toLocalIterator():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["part"], np.float64).reshape(CHUNK, columns)
    return out[:rows]


def count_passages(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total, live = np.zeros(n, np.int64), 0, np.ones(n, bool)
        for batch in batches:
            c, row, first = passages(batch, live, WIDTH)
            df += np.bincount(np.unique(row * n + c) % n, minlength=n)
            total += int(first[-1])
        yield chunks(np.stack([df, np.full(n, total)], axis=1))  # the number of passages rides along

    return run


def omega(n: int, rank: int) -> np.ndarray:
    return np.random.default_rng(9).normal(size=(n, rank)).astype(np.float32)


def add_sketch(total: np.ndarray, look: np.ndarray, c: np.ndarray, row: np.ndarray) -> None:
    """total += rows of A^T (A Omega) for words c in passages row (ascending); ``look`` is weight times Omega."""
    if not len(c):
        return
    at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    y = np.add.reduceat(look[c], at, axis=0)
    mine = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(row))))
    order = np.argsort(c, kind="stable")
    cc = c[order]
    at = np.flatnonzero(np.append(True, cc[1:] != cc[:-1]))
    total[cc[at]] += np.add.reduceat(y[mine[order]], at, axis=0)


def sketch(weight: np.ndarray, rank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, total, live = omega(len(weight), rank) * weight[:, None], np.zeros((len(weight), rank)), weight > 0
        for part in (x for batch in batches for x in slices(batch, "words", 4 * PROJECTED)):
            c, row, _ = passages(part, live, WIDTH)
            for i in range(0, len(c), PROJECTED):
                j = min(len(c), i + PROJECTED)
                add_sketch(total, look, c[i:j], row[i:j])
        yield chunks(total)

    return run


def leading_vectors(b: np.ndarray, weight: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of A from B = A^T A Omega: A^T A is about B (Omega^T B)^-1 B^T."""
    b = b * weight[:, None]
    core = omega(len(b), rank).T.astype(np.float64) @ b
    val, vec = np.linalg.eigh((core + core.T) / 2)
    good = val > max(val.max(initial=0.0) * 1e-10, 1e-12)
    if not good.any():
        return np.zeros((len(b), 1))
    return np.linalg.svd(b @ (vec[:, good] / np.sqrt(val[good])), full_matrices=False)[0]


@dataclass
class Index:
    ids: list
    words: list[np.ndarray]  #: word numbers of each item
    rare: list[np.ndarray]
    project: np.ndarray  #: word number to latent vector, times idf
    latent: np.ndarray  #: unit vectors of the items' passages
    length: np.ndarray
    item: np.ndarray  #: whose
    key_off: np.ndarray  #: word number to its stretch of ``key_item``
    key_item: np.ndarray  #: items that have the word among their keys
    need: np.ndarray  #: keys that every match of the item holds


def item_passages(c: np.ndarray):
    for s in range(0, max(1, len(c) - WIDTH + ITEM_STRIDE), ITEM_STRIDE):
        s = max(0, min(s, len(c) - WIDTH))
        yield c[s : s + WIDTH]


def key_words(item: np.ndarray, rare: np.ndarray, rarity: np.ndarray, lcs: float, answer: float) -> tuple[np.ndarray, int]:
    """Words of an item and how many of them every match holds: by the answer check or, without one, by the LCS limit."""
    if answer > 0:
        return rare, max(1, math.ceil(answer * len(rare) - 1e-9))
    spare = len(item) - math.ceil(lcs * len(item) - 1e-9)
    return np.unique(item[np.argsort(-rarity[item], kind="stable")[: spare + 1]]), 1


def build_index(ids: list, numbered: list[np.ndarray], idf: np.ndarray, rarity: np.ndarray, vectors: np.ndarray, lcs: float, answer: float) -> Index:
    project = (vectors * idf[:, None]).astype(np.float32)
    latent = np.stack([project[x].sum(axis=0) for c in numbered for x in item_passages(c)])
    item = np.array([k for k, c in enumerate(numbered) for _ in item_passages(c)])
    length = np.maximum(np.linalg.norm(latent, axis=1), 1e-9)
    rare = [np.unique(c[np.argsort(-rarity[c], kind="stable")[: max(2, -(-len(c) // 4))]]) for c in numbered]
    keys = [key_words(c, r, rarity, lcs, answer) for c, r in zip(numbered, rare, strict=True)]
    word, whose = np.concatenate([k for k, _ in keys]), np.repeat(np.arange(len(keys)), [len(k) for k, _ in keys])
    key_off = np.searchsorted(np.sort(word), np.arange(len(idf) + 1))
    return Index(ids, numbered, rare, project, latent / length[:, None], length, item, key_off, whose[np.argsort(word, kind="stable")], np.array([n for _, n in keys]))


def word_masks(item: np.ndarray) -> dict[int, int]:
    """Bit k of a word's mask: the item's k-th word is this one."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    return masks


def lcs_of(masks: dict[int, int], size: int, text: list[int]) -> int:
    """Longest common subsequence, bit-parallel over the item's words."""
    full = v = (1 << size) - 1
    for w in text:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def lcs_length(item: np.ndarray, text: np.ndarray) -> int:
    return lcs_of(word_masks(item), len(item), text.tolist())


def key_windows(index: Index, size: np.ndarray, numbers: np.ndarray, at: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(document, item, first word) of every window, a stride apart, whose surroundings hold enough of the item's keys."""
    count = np.diff(index.key_off)[numbers]
    hit = np.flatnonzero(count)
    which = np.repeat(hit, count[hit])
    item = index.key_item[ranges(index.key_off[numbers[hit]], count[hit])]
    group = (np.searchsorted(off, which, side="right") - 1) * len(size) + item
    order = np.argsort(group, kind="stable")  # places stay in ascending order
    group, item, place = group[order], item[order], at[which[order]].astype(np.int64)
    last = np.arange(len(order)) + index.need[item] - 1
    ok = last < len(order)
    last = np.minimum(last, len(order) - 1)
    ok &= (group[last] == group) & (place[last] - place < 2 * size[item] + WIDTH)
    group, item, place, last = group[ok], item[ok], place[ok], place[last[ok]]
    low = -(-np.maximum(0, last - WIDTH - size[item] + 1) // STRIDE)
    many = np.maximum(0, (place + size[item]) // STRIDE - low + 1)
    found = np.unique(np.stack([np.repeat(group, many), ranges(low, many)]), axis=1)
    for g, b in found.T.tolist():
        yield g // len(size), g % len(size), b * STRIDE


def search(index: Index, live: np.ndarray, cosine: float, lcs: float, answer: float):
    """Candidates by cosine and by key words, then verification; a passage's vector is the sum of two strides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, rare = [word_masks(c) for c in index.words], [frozenset(r.tolist()) for r in index.rare]
        floor = np.float32(0.4) * index.length.astype(np.float32)[None, :]
        own = [np.flatnonzero(index.item == k) for k in range(len(index.words))]

        def near_windows(found, c, row, first):
            cut = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            have = row[cut]
            sums = np.add.reduceat(index.project[c], cut, axis=0)
            seen = np.diff(np.append(cut, len(c)))
            doc = np.searchsorted(first, have, side="right") - 1
            pair, amount = sums.copy(), seen.copy()
            near = np.flatnonzero((have[1:] == have[:-1] + 1) & (doc[1:] == doc[:-1]))
            pair[near] += sums[near + 1]
            amount[near] += seen[near + 1]
            may = np.flatnonzero(amount >= 2)
            for i in range(0, len(may), 4096):
                z = pair[may[i : i + 4096]]
                norm = np.sqrt(np.einsum("ij,ij->i", z, z))
                close = z @ index.latent.T
                good = close >= np.float32(cosine) * floor
                good &= close >= np.float32(cosine) * norm[:, None]
                for w, k in np.argwhere(good).tolist():
                    m = may[i + w]
                    d = int(doc[m])
                    key = d, int(index.item[k]), int(have[m] - first[d]) * STRIDE
                    found[key] = max(found.get(key, -1.0), float(close[w, k] / max(float(norm[w]), 1e-9)))

        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_ratio", pa.float64()), ("answer_share", pa.float64()), ("word", pa.int64())])
        sizes = np.array([len(c) for c in index.words])
        for part in (x for batch in batches for x in slices(batch, "words", 4 * PROJECTED)):
            numbers, off = flat(part.column(1))
            numbers, at, off = numbers.view(np.int32), flat(part.column(2))[0].view(np.int32), off // 4
            if not len(numbers):
                continue
            ids = part.column(0).to_pylist()
            found: dict[tuple[int, int, int], float] = dict.fromkeys(key_windows(index, sizes, numbers, at, off), -1.0)
            c, row, first = passages(part, live, STRIDE)
            if len(c):
                near_windows(found, c, row, first)
            best: dict[tuple[int, int], tuple] = {}
            for (d, it, begin), value in found.items():
                size, mine = len(index.words[it]), at[off[d] : off[d + 1]]
                lo, hi = (mine.searchsorted([begin - size, begin + WIDTH + size]) + off[d]).tolist()
                text = numbers[lo:hi].tolist()
                share = len(rare[it].intersection(text)) / len(rare[it])
                if share < answer:
                    continue
                ratio = lcs_of(masks[it], size, text) / size
                if ratio < lcs or ratio < best.get((d, it), (0.0,))[0]:
                    continue
                if value < 0:
                    lo, hi = mine.searchsorted([begin, begin + WIDTH]) + off[d]
                    z = index.project[numbers[lo:hi]].sum(axis=0)
                    value = max(0.0, float((index.latent[own[it]] @ z).max()) / max(float(np.linalg.norm(z)), 1e-9))
                if (ratio, value) > best.get((d, it), (0.0, -1.0))[:2]:
                    best[d, it] = (ratio, value, share, begin)
            if best:
                yield pa.RecordBatch.from_pylist([{"doc_id": ids[d], "item_id": index.ids[it], "cosine": v[1], "lcs_ratio": v[0], "answer_share": v[2], "word": v[3]} for (d, it), v in best.items()], schema=schema)

    return run


def short_items(items: list[tuple]):
    """Documents with all words of an item in a row; an item is looked up by the word that the slice has least of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, "words", 4 * PROJECTED)):
            numbers, off = flat(part.column(1))
            numbers, at, off = numbers.view(np.int32), flat(part.column(2))[0].view(np.int32), off // 4
            order = np.argsort(numbers, kind="stable")
            ordered, hits = numbers[order], []
            for i, words in items:
                low, high = np.searchsorted(ordered, words), np.searchsorted(ordered, words, side="right")
                k = int(np.argmin(high - low))
                start = order[low[k] : high[k]] - k
                start = start[(start >= 0) & (start + len(words) <= len(numbers))]
                for j, w in enumerate(words.tolist()):
                    start = start[(numbers[start + j] == w) & (at[start + j] == at[start] + j)]
                doc = np.searchsorted(off, start, side="right") - 1
                inside = start + len(words) <= off[doc + 1]
                doc, first = np.unique(doc[inside], return_index=True)
                hits += [(d, i, int(at[s])) for d, s in zip(doc.tolist(), start[inside][first].tolist(), strict=True)]
            if hits:
                d, i, word = zip(*hits, strict=True)
                ids = part.column(0).take(pa.array(d))
                ones = pa.array([1.0] * len(d))
                yield pa.RecordBatch.from_arrays([ids, pa.array(i, pa.int64()), ones, ones, ones, pa.array(word, pa.int64())], names=["doc_id", "item_id", "cosine", "lcs_ratio", "answer_share", "word"])

    return run


FOUND = "doc_id long, words binary, at binary"
MATCH = "doc_id long, item_id long, cosine double, lcs_ratio double, answer_share double, word long"


def match_block(found: DataFrame, rows: list[tuple], vocabulary: Vocabulary, cosine: float, lcs: float, answer: float, common: float, least_words: int) -> DataFrame:
    """Matches of the items ``rows (id, word hashes)`` in the written words ``found`` of the corpus."""
    numbers = [(i, vocabulary.find(h)[1]) for i, h in rows]
    words_ = np.unique(np.concatenate([c for _, c in numbers]))
    if len(words_) < len(vocabulary.known):
        found = found.mapInArrow(tidy(of_block(words_)), FOUND)
        numbers = [(i, np.searchsorted(words_, c).astype(np.int32)) for i, c in numbers]
    short, whole = ([x for x in numbers if (len(x[1]) < least_words) == few] for few in (True, False))
    exact = found.mapInArrow(short_items(short), MATCH) if short else None
    if not whole:
        return exact
    n, numbered = len(words_), [c for _, c in whole]
    own = [x for c in numbered for x in item_passages(c)]
    rank = min(n, max(RANKS[0], min(RANKS[1], len(whole) // 2)))
    table = summed(found.mapInArrow(tidy(count_passages(n)), SUMS), n, 2)
    df, total = table[:, 0], table[0, 1] + len(own)
    for x in own:
        df[np.unique(x)] += 1
    rarity = np.log((total + 1) / (df + 1))
    idf = np.where(df > max(common * total, FLOOR), 0, rarity)
    weight = (idf / np.sqrt(np.maximum(df, 1))).astype(np.float32)
    b = summed(found.mapInArrow(tidy(sketch(weight, rank)), SUMS), n, rank)
    look = omega(n, rank) * weight[:, None]
    for x in own:
        x = x[weight[x] > 0]
        add_sketch(b, look, x, np.zeros(len(x), np.int64))
    index = build_index([i for i, _ in whole], numbered, idf, rarity, leading_vectors(b, weight, rank), lcs, answer)
    hits = found.mapInArrow(tidy(search(index, weight > 0, cosine, lcs, answer)), MATCH)
    return hits.union(exact) if short else hits


def contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch, cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER, common: float = COMMON, least_words: int = LEAST_WORDS, block: int = ITEM_BLOCK) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_ratio, answer_share, word`` (the passage's first word): one row for each match.

    ``cosine``, ``common`` and the gates in ``search`` steer the latent candidates only; the exact ones beside them miss no window that ``lcs`` and
    ``answer`` accept.  The items (a query set, of which only word numbers are kept) are read by the driver.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    hashed = []
    for r in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        h = tokens(raw, np.array([0, len(raw)]))[0]
        if len(h):
            hashed.append((r["item_id"], h))
    if not hashed:
        return docs.sparkSession.createDataFrame([], MATCH)
    vocabulary = Vocabulary(np.concatenate([h for _, h in hashed]))
    found = scratch.keep(texts.mapInArrow(tidy(number_words(vocabulary)), FOUND), "benchmark-words")
    out = None
    for k in range(0, len(hashed), block):
        hits = match_block(found, hashed[k : k + block], vocabulary, cosine, lcs, answer, common, least_words)
        out = hits if out is None else out.union(hits)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs_ratio", "cosine", "answer_share", (-F.col("word")).alias("w"))).alias("b"))
    return best.select("doc_id", "item_id", "b.cosine", "b.lcs_ratio", "b.answer_share", (-F.col("b.w")).alias("word"))


def brute_force(rows: list[tuple], items: list[tuple], lcs: float = LCS, least_words: int = LEAST_WORDS) -> set[tuple]:
    """(doc_id, item_id) by comparing every item with every stretch of every document; short items word for word."""

    def hashes(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return tokens(raw, np.array([0, len(raw)]))[0]

    out, queries = set(), [(k, hashes(x)) for k, x in items]
    for i, text in rows:
        h = hashes(text)
        for k, w in queries:
            if 0 < len(w) < least_words:
                found = any(np.array_equal(h[s : s + len(w)], w) for s in range(len(h) - len(w) + 1))
            else:
                found = len(w) > 0 and any(lcs_length(w, h[s : s + 2 * len(w)]) / len(w) >= lcs for s in range(0, max(1, len(h)), 8))
            if found:
                out.add((i, k))
    return out
