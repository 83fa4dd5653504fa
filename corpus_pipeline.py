"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents`` (``COLUMNS``; others
that the table may have are dropped by the first stage).  An empty table gives empty tables.

1. language_id - documents whose language is rejected (no letter, or a calibrated score under the threshold) go.
2. near_dedup - deletion-variant signatures of five-word shingles, similarity 0.8; of each group the document of smallest id stays.
3. suffix_dedup - stretches of ``REPEAT_WORDS`` words under repeated strings of ``REPEAT_BYTES`` go; documents that it leaves empty go too.
4. decontaminate - documents that hold a benchmark item go.
5. tokenise - byte-level BPE ids of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm import op3_langid, op4_similar, op5_suffix, op8_bpe, op9_decontam
from calibrant.llm.common import Scratch
from calibrant.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A repeat of over fifty words; no text of 51 words is shorter than 101 bytes.
REPEAT_WORDS, REPEAT_BYTES, REPEAT_ANCHOR = 51, 101, 48
SHINGLE, SIMILARITY = 5, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    out = op3_langid.language_id(docs.withColumn("kept", F.col("text")), carry=("kept", "lang", "source", "n_chars"))
    return out.where("not rejected").select("doc_id", F.col("kept").alias("text"), "lang", "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal ids in a group one row stays, too; the choice among them is by text."""
    docs = docs.select(*COLUMNS)
    groups = op4_similar.similar(docs, Scratch(spark), SHINGLE, SIMILARITY)
    stay = groups.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("kd"), "kt")).alias("s")).select("s.*").distinct()
    keyed = docs.withColumns({"kd": F.coalesce("doc_id", F.lit(2**63 - 1)), "kt": F.xxhash64(F.lit(0), F.coalesce("text", F.lit("")))})
    return keyed.join(stay, ["kd", "kt"], "left_semi").dropDuplicates(["kd", "kt"]).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A character that a cut would split goes as a whole."""
    docs = docs.select(*COLUMNS)
    out = op5_suffix.suffix_dedup(docs, Scratch(spark), REPEAT_BYTES, carry=("lang", "source"), characters=True, least_words=REPEAT_WORDS, anchor=REPEAT_ANCHOR)
    text = F.col("kept").cast("string")
    return out.where("n_bytes > n_removed or n_bytes = 0").select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told by id and text, so rows without an id, or with another's, are judged by themselves."""
    docs = docs.select(*COLUMNS)
    keyed = docs.withColumn("row", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))))
    hits = op9_decontam.contaminated(keyed.select(F.col("row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark))
    return keyed.join(hits.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = op8_bpe.bpe_round_trip(docs.select(*COLUMNS), vocabulary(), carry=("lang", "source"))
    return out.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontaminate", decontaminate), ("tokenise", tokenise)]

#: Language model, fingerprints and latent search have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again, and its own tables are deleted."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, opened = docs, len(Scratch.opened)
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        Scratch.sweep(opened)
        if name != STAGES[0][0]:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
