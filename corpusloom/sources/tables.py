"""Readers. Schemas are declared, nothing is inferred from data except by Parquet's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = (
    "conversation_id string, cases array<struct<id string, query string, relevant_chunk_ids array<string>, "
    "relevant_section_ids array<string>, expected_source_document string, relevant_source_contains array<string>, "
    "answer_facts array<string>, mode string, output_type string>>"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text, Markdown, CSV, TSV and JSON files, each as raw text; an empty file gives no row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row for each case of files {conversation_id, cases: [...]}; a case without query or evidence is an error."""
    case = spark.read.json(path, schema=CASES, multiLine=True).select("conversation_id", F.explode("cases").alias("c"))
    evidence = F.size(F.concat(*[F.coalesce(f"c.{k}", F.array().cast("array<string>")) for k in (
        "relevant_chunk_ids", "relevant_section_ids", "relevant_source_contains")])) > 0
    ok = (F.trim(F.coalesce("c.query", F.lit(""))) != "") & (evidence | F.col("c.expected_source_document").isNotNull())
    checked = F.when(ok, F.col("c.query")).otherwise(F.raise_error(F.lit("a case needs a query and evidence")))
    return case.select(
        "conversation_id", F.col("c.id").alias("id"), checked.alias("query"), "c.relevant_chunk_ids", "c.relevant_section_ids",
        "c.expected_source_document", "c.relevant_source_contains", "c.answer_facts", "c.mode", "c.output_type",
    )


def write_partition(rows: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of `key` that rows bring, leave the others: an idempotent upsert of whole documents."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


GENERATORS = "id string, name string, output_type string, endpoint string, enabled boolean, is_chat_default boolean"


def generator_registry(spark: SparkSession, path: str) -> DataFrame:
    """Generators of JSON files {generators: [...]}, those that are switched off left out; a small table to join by id or output_type."""
    rows = spark.read.json(path, schema=f"generators array<struct<{', '.join(x.replace(' ', ':', 1) for x in GENERATORS.split(', '))}>>", multiLine=True)
    return rows.select(F.explode("generators").alias("g")).select("g.*").where("coalesce(enabled, true)")


def write_artifacts(rows: DataFrame, path: str, key: str, payload: str) -> DataFrame:
    """Write payloads as JSON lines in a folder for each key, and return (key, path, sha256, n_bytes) of what was written."""
    rows.select(key, payload).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)
    where = F.concat(F.lit(f"{path}/{key}="), F.col(key).cast("string"))
    return rows.select(key, where.alias("path"), F.sha2(payload, 256).alias("sha256"), F.octet_length(payload).cast("bigint").alias("n_bytes"))


def write_report(rows: DataFrame, path: str, variant: str, metric: str) -> None:
    """A comparison of variants as JSON, CSV and a Mermaid bar chart, a folder each. Reports have a row for each variant."""
    one = rows.coalesce(1)
    one.write.mode("overwrite").json(f"{path}/json")
    one.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(variant, metric))), lambda x: F.concat(F.lit('"'), x[variant], F.lit('"'))), ", ")
    values = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(variant, metric))), lambda x: x[metric].cast("string")), ", ")
    chart = F.concat(F.lit("xychart-beta\n  x-axis ["), names, F.lit("]\n  bar ["), values, F.lit("]"))
    rows.agg(chart.alias("value")).write.mode("overwrite").text(f"{path}/mermaid")
