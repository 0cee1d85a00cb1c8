"""Stored course content: scans with optional filters, replacement, deletion with what depends on it, vectors, features, reports.

Tables are DataFrames; writing replaces whole partitions, so a run that is repeated gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a file goes through.
STATES = ("uploaded", "parsing", "chunking", "embedding", "ready")


def html_to_text(html: Column) -> Column:
    """Text of a page, each piece between tags on a line of its own, without scripts and styles; html without tags stays."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<![^>]*>", " ")
    lines = F.transform(F.split(F.regexp_replace(bare, r"<[^>]*>", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    text = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


def scan(rows: DataFrame, file: str, files: list[str] | None) -> DataFrame:
    """Rows of the named files: all of them for None, none for an empty list."""
    if files is None:
        return rows
    wanted = [f.strip() for f in dict.fromkeys(files) if f.strip()]
    return rows.where(F.col(file).isin(*wanted)) if wanted else rows.limit(0)


def of_parents(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is among the given ones."""
    return rows.join(parents.select(key).distinct(), key, "left_semi")


def replaced(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """stored, with the fresh rows in place of all rows of their keys."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def without(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Tables (rows, their column of the key) without what belongs to the keys that go."""
    g = gone.select(key).distinct()
    return {name: rows.join(g.withColumnRenamed(key, column), column, "left_anti") for name, (rows, column) in tables.items()}


def upsert_vectors(stored: DataFrame, fresh: DataFrame, key: str, model: str, dim: int) -> DataFrame:
    """Vectors (key, embedding, model, dim) with fresh ones (key, embedding) in place of older ones; those of another model or length are dropped, as
    a collection of another dimension is made anew."""
    new = fresh.select(key, "embedding", F.lit(model).alias("model"), F.size("embedding").alias("dim")).where(F.col("dim") == dim)
    held = stored.where((F.col("model") == model) & (F.col("dim") == dim))
    return held.join(new.select(key), key, "left_anti").unionByName(new)


def vector_status(vectors: DataFrame, chunks: DataFrame, key: str, scope: str, model: str, dim: int) -> DataFrame:
    """(scope, total, embedded, stale, ready) of chunks and their vectors."""
    v = vectors.select(key, ((F.col("model") == model) & (F.col("dim") == dim)).alias("fresh"))
    g = chunks.select(scope, key).join(v, key, "left").groupBy(scope).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("fresh").alias("embedded"), F.count_if(~F.col("fresh")).alias("stale")
    )
    return g.withColumn("ready", F.col("embedded") == F.col("total"))


def next_state(state: Column, failed: Column, retry: Column) -> Column:
    """The state after a step: the next of STATES, "failed" on failure, "uploaded" again for a failed file that is retried; ready stays."""
    moved = F.lit(STATES[-1])
    for a, b in zip(STATES, STATES[1:]):
        moved = F.when(state == a, b).otherwise(moved)
    return F.when(state == "failed", F.when(retry, "uploaded").otherwise("failed")).when(failed & (state != "ready"), "failed").otherwise(moved)


def progress_log(events: DataFrame, key: str, at: str, percent: str) -> DataFrame:
    """The last event of each key with its percent held between 0 and 100, and how many there were."""
    held = F.greatest(F.lit(0), F.least(F.lit(100), F.col(percent).cast("int")))
    g = events.groupBy(key).agg(F.max_by(held, at).alias("percent"), F.count(F.lit(1)).alias("n_events"), F.max(at).alias("last"))
    return g


def feature_rows(sections: DataFrame, features: dict[str, Column]) -> DataFrame:
    """(doc_id, section, kind, pos, value): typed features of sections, one row each."""
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), values.alias("v")) for kind, values in features.items()])
    rows = sections.select("doc_id", "section", F.explode_outer(each).alias("f")).select("doc_id", "section", "f.kind", F.posexplode("f.v").alias("pos", "value"))
    return rows


def interrupted(jobs: DataFrame, status: str, started: str, now: Column, minutes: int) -> DataFrame:
    """Jobs that were running and have not moved for more than so many minutes, to the microsecond."""
    old = F.unix_micros(now) - F.unix_micros(started) > minutes * 60_000_000
    return jobs.where(F.col(status).isin("parsing", "chunking", "embedding", "running") & old)
