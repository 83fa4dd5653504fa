"""Models behind three interfaces, run batch by batch in Spark's Python workers.

A *factory* is called once for each partition and returns the model: weights are loaded there, never on the driver.

* scorer: ``model(prompts, options, contexts) -> logits`` of each row's options;
* generator: ``model(prompts) -> texts``;
* embedder: ``model(texts) -> vectors``.

A row whose batch fails is tried alone; if it fails again it keeps null and its error, and no other row is lost.
The stand-ins are deterministic; they test dataflows and say nothing about a model's quality.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMBEDDERS = ("tfidf", "sentence_transformers")
DEFAULT_EMBEDDING = "all-MiniLM-L6-v2"


def _apply(df: DataFrame, factory: Callable, inputs: tuple[str, ...], out: str, kind: str, batch: int) -> DataFrame:
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in (out, f"{out}_error")]
    keep = [f.name for f in df.schema.fields if f.name not in (out, f"{out}_error")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                columns = [part[c].tolist() for c in inputs]
                try:
                    values, errors = list(model(*columns)), [None] * len(part)
                    if len(values) != len(part):
                        raise ValueError(f"{len(values)} results for {len(part)} rows")
                except Exception:  # noqa: BLE001
                    values, errors = [], []
                    for row in zip(*columns, strict=True):
                        try:
                            values.append(list(model(*[[x] for x in row]))[0])
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            values.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
                yield part[keep].assign(**{out: values, f"{out}_error": errors})

    return df.mapInPandas(run, ", ".join([*names, f"`{out}` {kind}", f"`{out}_error` string"]))


def score(rows: DataFrame, factory: Callable, batch: int = 40) -> DataFrame:
    """Rows ``(prompt, options, context)`` with ``logits array<double>`` and ``logits_error``."""
    return _apply(rows, factory, ("prompt", "options", "context"), "logits", "array<double>", batch)


def generate(rows: DataFrame, factory: Callable, prompt: str, out: str, batch: int = 40) -> DataFrame:
    return _apply(rows, factory, (prompt,), out, "string", batch)


def embed(rows: DataFrame, factory: Callable, text: str, out: str, batch: int = 128) -> DataFrame:
    return _apply(rows, factory, (text,), out, "array<double>", batch)


def from_table(predictions: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A scorer that joins logits from a table ``(sample_id, logits)``: how a model's output enters that was computed elsewhere."""
    return lambda rows: rows.join(predictions.select("sample_id", "logits"), "sample_id", "left")


def embedding_model(name: str) -> tuple[str, str | None]:
    """(kind, model name): a known kind is itself, any other text the name of a sentence model; ``openai`` has no local model and falls back to TF-IDF."""
    if name in ("tfidf", "openai"):
        return "tfidf", None
    return "sentence_transformers", DEFAULT_EMBEDDING if name == "sentence_transformers" else name


# ---- deterministic stand-ins -------------------------------------------------------------------------------------


def _number(*parts: str) -> float:
    """Pseudo-random, from 0 to 1."""
    return int.from_bytes(hashlib.sha256("\x1f".join(parts).encode()).digest()[:6], "big") / 2**48


def hash_scorer() -> Callable:
    return lambda prompts, options, contexts: [[2 * _number(p or "", o) for o in os] for p, os in zip(prompts, options, strict=True)]


def overlap_scorer() -> Callable:
    """How many of an option's words the context holds."""

    def model(prompts, options, contexts):
        return [[float(len(set(o.lower().split()) & set((c or "").lower().split()))) for o in os] for os, c in zip(options, contexts, strict=True)]

    return model


def echo_generator(words: int = 12) -> Callable:
    """The last words of the prompt."""
    return lambda: lambda prompts: [" ".join((p or "").split()[-words:]) for p in prompts]


def tail_generator() -> Callable:
    """Behind the first line of the prompt, as many of the last words as the first line has."""

    def model(prompts):
        for p in prompts:
            first, _, rest = (p or "").partition("\n")
            yield " ".join(rest.split()[-max(1, len(first.split())) :])

    return lambda prompts: list(model(prompts))


def hashed_embedder(dim: int = 64) -> Callable:
    """A unit vector of hashed words."""

    def factory():
        def model(texts):
            for text in texts:
                v = [0.0] * dim
                for w in (text or "").lower().split():
                    v[int(_number(w) * dim)] += 1.0
                norm = math.sqrt(sum(x * x for x in v))
                yield [x / norm for x in v] if norm else v

        return lambda texts: list(model(texts))

    return factory


def retrieval_decider() -> Callable:
    """A generator that asks for retrieval when the prompt has over 120 characters, in reflection tokens."""
    return lambda prompts: ["<|retrieve|>" if len(p or "") > 120 else "<|no_retrieve|>" for p in prompts]


def reflecting_generator() -> Callable:
    """Reflection tokens that depend on the prompt only."""

    def model(prompts):
        for p in prompts:
            u = _number(p or "")
            yield f"{'<|relevant|>' if u < 0.6 else '<|irrelevant|>'}{'<|fully_supported|>' if u < 0.3 else '<|partially_supported|>' if u < 0.7 else '<|no_support|>'}<|utility:{1 + int(u * 5)}|>"

    return lambda prompts: list(model(prompts))


def with_errors(rows: DataFrame, column: str, fallback) -> DataFrame:
    """Failed rows get ``fallback`` and keep their error."""
    return rows.withColumn(column, F.coalesce(F.col(column), fallback))
