"""Sources and sinks: text documents, paged text, gold sets, prices, call logs, runs and caches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import short_hash
from spanloom.schemas import BadInput, ExtractionSchema
from spanloom.sources import storage

CALLS = (
    "run_id string, variant string, doc_id string, chunk_id string, stage string, provider string, model string, request_id string, started_at timestamp, latency_ms double, wall_ms double, attempts int, "
    "status_codes array<int>, request_bytes bigint, response_bytes bigint, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, question_count int, state_chars int, cached boolean, error string"
)
GOLD = "id string, text string, entities array<struct<text:string,type:string>>, relations array<struct<source:string,type:string,target:string>>"


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Plain text files as one-page documents, in one scan."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("title"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return raw.select(short_hash(F.col("text")).alias("doc_id"), F.sha2("text", 256).alias("sha256"), "path", "title", F.lit(1).alias("page_count"), "text")


def binary_documents(spark: SparkSession, path: str, extract) -> DataFrame:
    """Binary files (a PDF, say) through a page extractor: extract(bytes) -> list of page texts.

    No extractor is bundled. One document is in memory at a time; a file it can't read gives no pages.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))

    def run(batches):
        import pandas as pd

        for batch in batches:
            for r in batch.itertuples():
                pages = extract(r.content)
                yield pd.DataFrame({"doc_id": r.sha256[:16], "sha256": r.sha256, "path": r.path, "page": range(1, len(pages) + 1), "text": pages})

    return files.mapInPandas(run, "doc_id string, sha256 string, path string, page int, text string")


def load_gold(spark: SparkSession, path: str, schema: ExtractionSchema) -> DataFrame:
    """Gold passages of a folder's *.json, checked: entities occur verbatim with known types, relations join labelled entities."""
    gold = spark.read.schema(GOLD).option("multiLine", True).json(f"{path}/*.json")
    known = F.array(*map(F.lit, schema.kinds))
    bad_entity = F.exists("entities", lambda e: ~F.contains("text", e["text"]) | ~F.array_contains(known, e["type"]))
    labelled = F.transform("entities", lambda e: e["text"])
    bad_relation = F.exists("relations", lambda r: ~F.array_contains(labelled, r["source"]) | ~F.array_contains(labelled, r["target"]))
    wrong = [r[0] for r in gold.where(bad_entity | bad_relation).select("id").limit(5).collect()]
    if wrong:
        raise BadInput(f"gold passages that don't hold: {wrong}")
    return gold


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    raw = json.loads(storage.read_text(spark, path))
    return spark.createDataFrame([(m, float(p["input"]), float(p["output"]), p.get("cacheRead"), p.get("cacheWrite")) for m, p in raw.items()], "model string, input double, output double, cache_read double, cache_write double")


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines call log; a missing one is empty, blank lines don't count."""
    if not storage.exists(spark, path):
        return spark.createDataFrame([], CALLS)
    return spark.read.schema(CALLS).json(path)


def append_calls(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").json(path)


def write_artifact(df: DataFrame, root: str, name: str) -> None:
    """One stage's table of a run; df has run_id, which becomes the partition. Other runs stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{name}")


def read_run(spark: SparkSession, root: str, run_id: str, names: tuple[str, ...] = ("documents", "segments", "mentions", "entities", "relations", "manifest")) -> dict[str, DataFrame]:
    """A run's tables, by partition pruning on run_id."""
    return {n: spark.read.parquet(f"{root}/{n}").where(F.col("run_id") == run_id) for n in names if storage.exists(spark, f"{root}/{n}")}


def finished_runs(manifests: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Runs that have a manifest, with their accuracy where there is one."""
    return manifests.join(accuracy, "run_id", "left")


def add_to_cache(cache: DataFrame | None, answers: DataFrame, path: str, key: str = "cache_key") -> None:
    """New keys are appended; known ones stay as they are."""
    fresh = answers.dropDuplicates([key])
    (fresh if cache is None else fresh.join(cache.select(key), key, "left_anti")).write.mode("append").parquet(path)


def write_accuracy(spark: SparkSession, judgements: DataFrame, accuracy: dict, root: str) -> None:
    """A run's judgements as JSON lines and its accuracy, one object."""
    judgements.write.mode("overwrite").json(f"{root}/judge.jsonl")
    storage.create_text(spark, f"{root}/accuracy.json", json.dumps(accuracy, indent=2, ensure_ascii=False), overwrite=True)


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted where a field needs it, quotes doubled, with a header; one folder of parts."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_bench(calls: DataFrame, failures: DataFrame, gold: DataFrame, root: str) -> None:
    """What a benchmark leaves: its calls, a line for each failure, and the gold scores."""
    calls.write.mode("overwrite").json(f"{root}/calls.jsonl")
    failures.write.mode("overwrite").text(f"{root}/failures.txt")
    gold.write.mode("overwrite").json(f"{root}/gold.json")


def dashboard_tables(spark: SparkSession, root: str, run_ids: list[str]) -> dict[str, DataFrame]:
    """The tables a dashboard shows of some runs, each with its run's ordinal in the order asked for."""
    order = spark.createDataFrame(list(enumerate(run_ids)), "ordinal int, run_id string")
    names = ("documents", "mentions", "entities", "relations", "manifest")
    return {n: spark.read.parquet(f"{root}/{n}").where(F.col("run_id").isin(run_ids)).join(order, "run_id") for n in names if storage.exists(spark, f"{root}/{n}")}
