"""Operator 3: language identification by averaged hashed subword embeddings and a linear softmax.

Features are the byte 2-, 3- and 4-grams of the lower-cased letters (one space for anything else), hashed into a fixed
number of buckets; a document's vector is the mean of its features' embeddings.  Embeddings and softmax are trained
by stochastic gradient descent in numpy on a bounded sample: ``PER_LANG`` labelled rows of each language (fewer where ``TOTAL`` in all would be
exceeded, the same for each), those of least hash of the id, with texts of at most ``SAMPLE_BYTES``; of more than ``LANGS`` languages the most
frequent are learnt.  A fifth of it calibrates:
a temperature by likelihood, then the rejection threshold, the score that all but ``reject`` of the right answers reach (at most 0.5).

Embedding times softmax is one table (buckets x languages), so a prediction is a mean over table rows, in numpy on flat
Arrow buffers, over whole texts.

Edge cases: null text and text without a letter are ``und`` with score 0, and rejected; without labelled rows there is no
language to learn and all are ``und``; null ids are neither held out nor learnt from; ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, slices, tidy
from .textnorm import letters

BUCKETS, DIM, GRAMS = 1 << 17, 16, (2, 3, 4)
PER_LANG, TOTAL, SAMPLE_BYTES, LANGS = 600, 20_000, 32_768, 256
EPOCHS, BATCH, RATE, REJECT = 5, 32, 25.0, 0.002


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  #: (buckets + 1, languages), the last row is zero
    bias: np.ndarray
    temperature: float
    threshold: float


def features(data: np.ndarray, off: np.ndarray):
    """Bucket of every gram, by gram length; grams that would leave their document point to the zero row."""
    data, off = letters(data, off)
    n = len(data)
    pad = np.zeros(n + 3, np.uint32)
    pad[:n] = data
    code = pad[:n].copy()
    ends = off[1:]
    for g in range(2, max(GRAMS) + 1):
        code = (code << np.uint32(8)) | pad[g - 1 : g - 1 + n]
        if g in GRAMS:
            bucket = ((code + np.uint32(g * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1) >> np.uint32(32 - 17)).astype(np.int64)
            for k in range(1, g):
                at = ends - k
                bucket[at[(at >= off[:-1]) & (at >= 0)]] = BUCKETS
            yield bucket, off


def scores(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Logits of each document of a flat buffer."""
    total, count = np.zeros((len(off) - 1, len(model.langs)), np.float64), np.zeros(len(off) - 1)
    for bucket, at in features(data, off):
        some = np.flatnonzero(np.diff(at))
        if len(some):
            total[some] += np.add.reduceat(model.table[bucket], at[:-1][some], axis=0)
            count[some] += np.add.reduceat((bucket != BUCKETS).astype(np.int64), at[:-1][some])
    return total / np.maximum(count, 1)[:, None] + model.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 1) -> Model | None:
    """rows: (language, text)."""
    rows = sorted(r for r in rows if r[0] is not None and regex.search(r"\p{L}", r[1] or ""))
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    y = np.array([langs.index(r[0]) for r in rows])
    docs = []
    for _, text in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, n = np.unique(np.concatenate([b for b, _ in features(raw, np.array([0, len(raw)]))]), return_counts=True)
        ids, n = ids[ids < BUCKETS], n[ids < BUCKETS]
        docs.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    check = order[: len(order) // 5] if len(order) >= 20 else order
    learn = order[len(order) // 5 :] if len(order) >= 20 else order
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for i in range(0, len(learn), BATCH):
            part = rng.permutation(learn[i : i + BATCH])
            ids = np.concatenate([docs[d][0] for d in part])
            val = np.concatenate([docs[d][1] for d in part])
            row = np.repeat(np.arange(len(part)), [len(docs[d][0]) for d in part])
            x = np.zeros((len(part), DIM), np.float32)
            np.add.at(x, row, emb[ids] * val[:, None])
            g = softmax(x @ w + b).astype(np.float32)
            g[np.arange(len(part)), y[part]] -= 1
            back = g @ w.T
            w -= np.float32(0.02) * rate * (x.T @ g) / len(part) * 4
            b -= np.float32(0.002) * rate * g.mean(axis=0)
            np.add.at(emb, ids, -rate * val[:, None] * back[row])
    table = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    table[:BUCKETS] = emb @ w
    model = Model(langs, table, b.astype(np.float64), 1.0, 0.0)
    raw = [rows[d][1].encode() for d in check]
    logits = scores(model, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    grid = 2.0 ** np.arange(-3, 4.25, 0.25)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    model.threshold = float(min(0.5, np.quantile(right, REJECT))) if len(right) else 0.0
    return model


def predict(shared):
    """``shared``: broadcast variable of the model."""
    letter = regex.compile(r"\p{L}").search
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                names = part.schema.names
                text = part.column(names.index("text"))
                data, off = flat(text)
                n = part.num_rows
                has = np.zeros(n, bool)
                some = np.flatnonzero(np.diff(off))
                if len(some):
                    has[some] = np.logical_or.reduceat(ascii_letter[data], off[:-1][some])
                for i in np.flatnonzero(~has & (np.diff(off) > 0)).tolist():
                    has[i] = letter(data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")) is not None
                if model is None:
                    lang, score, out = ["und"] * n, np.zeros(n), np.ones(n, bool)
                else:
                    p = softmax(scores(model, data, off) / model.temperature)
                    best = p.argmax(axis=1)
                    lang = [model.langs[k] if h else "und" for k, h in zip(best.tolist(), has.tolist(), strict=True)]
                    score = np.where(has, p[np.arange(n), best], 0.0)
                    out = ~has | (score < model.threshold)
                rest = [i for i, k in enumerate(names) if k != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out)], names=[*(names[i] for i in rest), "lang_pred", "score", "rejected"])

    return run


def remainder(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def sample(docs: DataFrame, per_lang: int = PER_LANG, total: int = TOTAL, langs: int = LANGS) -> list[tuple[str, str]]:
    """The bounded training sample: languages are counted first, then the rows of least hash of each are chosen, then their texts read.

    No language's rows are gathered: rows over a hash limit that leaves about twice the wanted number go before the exchange.
    """
    may = docs.where((remainder() != 2) & F.col("lang").isNotNull()).withColumn("h", F.xxhash64("doc_id"))
    counts = may.groupBy("lang").agg(F.count(F.lit(1)).alias("c"), F.min("h").alias("least")).orderBy(F.desc("c"), "lang").limit(langs).collect()
    if not counts:
        return []
    want = max(1, min(per_lang, total // len(counts)))
    limit = [(r["lang"], max(r["least"], min(2**63 - 1, -(2**63) + int(2**64 * (2 * want + 50) / r["c"])))) for r in counts]
    near = may.join(F.broadcast(docs.sparkSession.createDataFrame(limit, "lang string, most long")), "lang").where("h <= most")
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    cut = near.select("lang", "h", "doc_id").withColumn("k", F.row_number().over(w)).where(F.col("k") <= want).groupBy("lang").agg(F.max("h").alias("cut")).collect()
    chosen = docs.sparkSession.createDataFrame([(r["lang"], r["cut"]) for r in cut], "lang string, cut long")
    rows = may.join(F.broadcast(chosen), "lang").where((F.col("h") <= F.col("cut")) & (F.octet_length("text") <= SAMPLE_BYTES))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= want)
    return [(r["lang"], r["text"]) for r in rows.select("lang", "text").collect()]


def language_id(docs: DataFrame, carry: tuple[str, ...] = (), model: Model | None = None) -> DataFrame:
    """``doc_id``, ``carry``, ``held_out, lang_pred, score, rejected`` of every row; trained on ``docs`` unless a model is given."""
    model = model or train(sample(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, at most 128 MB
    base = docs.select("doc_id", *carry, F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "text")
    return base.withColumn("text", F.col("text").cast("binary")).mapInArrow(tidy(predict(shared)), f"{types}, lang_pred string, score double, rejected boolean")
