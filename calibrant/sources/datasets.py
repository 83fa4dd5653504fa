"""Evaluation datasets, corpora, result sinks and local knowledge tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Required fields of a sample (fixed values).
REQUIRED = ("id", "question", "options", "correct_answer")
SEARCH = "array<struct<page_result string, page_snippet string, page_title string, page_name string, page_url string, page_rank int, page_score double, persistent_storage array<string>>>"
SAMPLE = f"struct<id string, question string, options array<string>, correct_answer string, answer string, search_results {SEARCH}, query_time string, technique string, metadata map<string,string>>"
ENVELOPE = f"name string, description string, version string, calibration array<{SAMPLE}>, test array<{SAMPLE}>"


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """One row per sample of both splits: ``split, ordinal``, the sample's fields, ``correct_answer`` as an array.

    Raises for a missing split, and for the first sample without a required field.
    """
    raw = spark.read.schema(ENVELOPE).option("multiLine", True).json(path)
    both = F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("rows")) for s in ("calibration", "test")])
    splits = raw.select(F.explode(both).alias("x")).select("x.*")
    if (gone := splits.where("rows is null").first()) is not None:
        raise ValueError(f"dataset has no {gone['split']} array")
    rows = splits.select("split", F.posexplode("rows").alias("ordinal", "s")).select("split", "ordinal", "s.*")
    bad = rows.where(" or ".join(f"{c} is null" for c in REQUIRED)).orderBy("split", "ordinal").first()
    if bad is not None:
        name = next(c for c in REQUIRED if bad[c] is None)
        raise ValueError(f"sample {bad['ordinal']} of {bad['split']} has no {name}")
    return rows.withColumn("correct_answer", answers(F.col("correct_answer")))


def answers(raw: Column) -> Column:
    """A label or a JSON array of labels as an array."""
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))


def read_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array, or one object as a single row."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def load_config(text: str) -> dict:
    """A run's configuration from YAML; ``system``, ``dataset`` and ``system.name`` are required."""
    import yaml

    config = yaml.safe_load(text) or {}
    for key in ("system", "dataset"):
        if key not in config:
            raise ValueError(f"configuration has no {key}")
    if "name" not in config["system"]:
        raise ValueError("configuration has no system.name")
    return config


class Corpora:
    """Named corpora ``(doc_id, text)``; a lookup keeps request order and duplicates and ignores unknown names."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    def get(self, names: list[str]) -> DataFrame | None:
        out = None
        for i, name in enumerate(names):
            if name in self.tables:
                part = self.tables[name].select(F.lit(i).alias("request"), F.lit(name).alias("corpus"), F.col("doc_id").cast("long"), "text")
                out = part if out is None else out.unionByName(part)
        return out


def titled(title: Column, body: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\nContent: "), body)


def solved(problem: Column, solution: Column) -> Column:
    return F.concat(F.lit("Problem: "), problem, F.lit("\nSolution: "), solution)


def dialogue(context: Column, response: Column) -> Column:
    """The separator is a literal backslash."""
    return F.concat(F.lit("Context: "), context, F.lit("\\Response: "), response)


def lookup(table: DataFrame, **keys) -> DataFrame:
    """Keyed lookup on a local knowledge table: None is no condition, a list is a semi-join."""
    for column, value in keys.items():
        if isinstance(value, list):
            wanted = table.sparkSession.createDataFrame([(v,) for v in value], f"{column} {table.schema[column].dataType.simpleString()}")
            table = table.join(wanted, column, "left_semi")
        elif value is not None:
            table = table.where(F.col(column) == F.lit(value))
    return table


#: The knowledge lookups by domain: key columns, then optional ones after a bar (fixed values: the names that callers use).
LOOKUPS = {
    "open": {"search_entity_by_name": "query", "get_entity": "query"},
    "movie": {"get_person_info": "query", "get_movie_info": "query", "get_year_info": "query", "get_movie_info_by_id": "query", "get_person_info_by_id": "query"},
    "finance": {"get_company_name": "query", "get_ticker_by_name": "query", "get_price_history": "query", "get_detailed_price_history": "query", "get_dividends_history": "query", "get_market_capitalization": "query", "get_eps": "query", "get_pe_ratio": "query", "get_info": "query"},
    "music": {
        "search_artist_entity_by_name": "query", "search_song_entity_by_name": "query", "get_billboard_rank_date": "rank | date", "get_billboard_attributes": "date, attribute, song_name",
        "grammy_get_best_artist_by_year": "query", "grammy_get_award_count_by_artist": "query", "grammy_get_award_count_by_song": "query", "grammy_get_best_song_by_year": "query", "grammy_get_award_date_by_artist": "query",
        "grammy_get_best_album_by_year": "query", "grammy_get_all_awarded_artists": "", "get_artist_birth_place": "query", "get_artist_birth_date": "query", "get_members": "query", "get_lifespan": "query",
        "get_song_author": "query", "get_song_release_country": "query", "get_song_release_date": "query", "get_artist_all_works": "query",
    },
    "sports": {"soccer_get_games_on_date": "date | team_name", "nba_get_games_on_date": "date | team_name", "nba_get_play_by_play_data_by_game_ids": "game_ids"},
}


class Knowledge:
    """The lookups over local tables ``{domain_name: table}`` that have their key columns; a list of keys is a semi-join on the key (``game_ids`` on ``game_id``)."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    @staticmethod
    def keys(domain: str, name: str) -> tuple[list[str], list[str]]:
        if name not in LOOKUPS.get(domain, {}):
            raise ValueError(f"unknown lookup {domain}.{name}")
        first, _, rest = LOOKUPS[domain][name].partition("|")
        need, may = ([k.strip() for k in part.split(",") if k.strip()] for part in (first, rest))
        return need, may

    def call(self, domain: str, name: str, **values) -> DataFrame:
        need, may = self.keys(domain, name)
        if (gone := [k for k in need if k not in values]) or (more := [k for k in values if k not in (*need, *may)]):
            raise ValueError(f"{domain}.{name} lacks {gone}" if gone else f"{domain}.{name} does not know {more}")
        if f"{domain}_{name}" not in self.tables:
            raise ValueError(f"no table for {domain}.{name}")
        return lookup(self.tables[f"{domain}_{name}"], **{k.removesuffix("s") if isinstance(v, list) else k: v for k, v in values.items()})


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, in any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_results(evaluated: DataFrame, metrics: DataFrame, path: str) -> None:
    """Calibration and test results as JSON lines, and the one row of metrics as a single JSON file, ``evaluation_metrics.json``."""
    for split in ("calibration", "test"):
        evaluated.where(F.col("split") == split).drop("split").write.mode("overwrite").json(f"{path}/{split}_results")
    row = json.loads(metrics.toJSON().first())
    write_text(metrics.sparkSession, f"{path}/evaluation_metrics.json", json.dumps(row, indent=4))


def report(metrics: DataFrame) -> DataFrame:
    """``line, text``: the result report, one row a line, numbers with four decimals."""
    lines = (("Total Samples", "total_samples", "%d"), ("Accuracy", "accuracy", "%.4f"), ("LAC Coverage", "lac_coverage", "%.4f"), ("APS Coverage", "aps_coverage", "%.4f"), ("LAC Avg Set Size", "lac_avg_set_size", "%.4f"), ("APS Avg Set Size", "aps_avg_set_size", "%.4f"), ("  LAC Threshold", "lac_threshold", "%.4f"), ("  APS Threshold", "aps_threshold", "%.4f"))
    texts = F.array(*[F.format_string(f"{name}: {form}", F.col(c)) for name, c, form in lines if c in metrics.columns])
    return metrics.select(F.posexplode(texts).alias("line", "text"))


def not_yet_run(configs: DataFrame, done: DataFrame) -> DataFrame:
    return configs.join(done, "config", "left_anti")


def run_pending(spark: SparkSession, runs: dict, path: str) -> list[str]:
    """Call each run whose folder has no metrics file yet with that folder; the names of those that ran."""
    ran = []
    for name, run in runs.items():
        if not exists(spark, f"{path}/{name}/evaluation_metrics.json"):
            run(f"{path}/{name}")
            ran.append(name)
    return ran
