"""Chunkers as column functions: each gives an array of chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calibrant.functions.text import strip, tokens

SIZE, OVERLAP = 500, 50


def sliding(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` words every ``size - overlap``; the last may lie inside the one before."""
    step = size - overlap
    if step == 0:
        raise ValueError("overlap must differ from size")
    if step < 0:
        return F.array().cast("array<string>")

    def cut(words: Column) -> Column:
        starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))

    # the words are an element that the inner function gets, so the text is split once, not once a window
    return F.when(text.isNotNull(), F.flatten(F.transform(F.array(tokens(text)), cut)))


def sentences(text: Column, least: int = 10, most: int = 1000) -> Column:
    """Sentences of more than ``least`` characters, cut to ``most`` afterwards."""
    found = F.transform(F.regexp_extract_all(text, F.lit("[^.!?]+[.!?]*"), F.lit(0)), strip)
    return F.transform(F.filter(found, lambda s: F.length(s) > least), lambda s: F.substring(s, 1, most))


def _pack(parts: Column, size: int, glue: str) -> Column:
    """Greedy packing by words: a part that would exceed ``size`` starts a new chunk; an oversize part stays whole.

    The fold copies an array of references at each finished chunk; chunks are built by one concatenation each.
    """
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(a, p):
        k = F.size(tokens(p))
        fits = (a["n"] == 0) | (a["n"] + k <= size)
        return F.when(
            fits, F.struct(a["done"].alias("done"), F.when(a["n"] == 0, p).otherwise(F.concat(a["now"], F.lit(glue), p)).alias("now"), (a["n"] + k).alias("n"))
        ).otherwise(F.struct(F.concat(a["done"], F.array(a["now"])).alias("done"), p.alias("now"), k.alias("n")))

    return F.aggregate(parts, zero, step, lambda a: F.when(a["n"] > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))


def sentence_parts(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]+"), strip), lambda s: s != "")


def paragraph_parts(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda s: s != "")


#: Parts of a text and what stands between those of a chunk.
PARTS = {"sentence": (sentence_parts, " "), "paragraph": (paragraph_parts, "\n\n")}


def sentence_pack(text: Column, size: int = SIZE) -> Column:
    return _pack(sentence_parts(text), size, " ")


def paragraph_pack(text: Column, size: int = SIZE) -> Column:
    return _pack(paragraph_parts(text), size, "\n\n")


METHODS = {"sliding_window": sliding, "sentence": sentence_pack, "paragraph": paragraph_pack, "sentence_spans": sentences}


def chunk(text: Column, method: str = "sliding_window", **options) -> Column:
    if method not in METHODS:
        raise ValueError(f"unknown chunking method {method!r}; known: {sorted(METHODS)}")
    return METHODS[method](text, **options)
