"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import broadcast_if_few, new_path, small_batches, stage  # noqa: F401  for the other modules

#: White space that separates words: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut into slices of about `most` bytes of a column of texts and one row at least: what Python makes of
    the texts is held for a slice, not for a batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row; a plain reuse could be inlined into every lambda call."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null stays null."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def columns(docs: DataFrame) -> list[Column]:
    """All columns, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def without(docs: DataFrame, key: Column, verdicts: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, key) has no verdict `keep` = false; where `keep` is true one row of (doc_id, key) stays.

    verdicts (doc_id, key, keep) has a row for each (doc_id, key) to drop, or of which one row of several is to stay, so
    that rows which repeat everything don't both go or both stay. doc_id may be null.
    """
    names = [f"{n}_{uuid.uuid4().hex}" for n in ("id", "unknown", "key", "keep")]
    asked = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), F.col("doc_id").isNull(), key]
    marked = docs.withColumns(dict(zip(names, asked)))
    known = verdicts.select(
        F.coalesce("doc_id", F.lit(0)).alias(names[0]), F.col("doc_id").isNull().alias(names[1]), F.col("key").alias(names[2]), F.col("keep").alias(names[3])
    )
    on = names[:3]
    left = marked.join(broadcast_if_few(known), on, "left_anti").select(columns(docs))
    again = known.where(F.col(names[3]))
    if again.isEmpty():
        return left
    return left.unionByName(marked.join(broadcast_if_few(again), on).dropDuplicates(on).select(columns(docs)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binomial_tail_log(n: Column, k: Column, rate: float) -> Column:
    """Natural log of P(Binomial(n, rate) <= k), summed exactly over its k + 1 terms in the log domain."""
    odds = F.log(F.lit(rate / (1.0 - rate)))
    start = n * F.log(F.lit(1.0 - rate))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(acc["total"], term)
        return F.struct(
            term.alias("term"),
            (top + F.log(F.exp(acc["total"] - top) + F.exp(term - top))).alias("total"),
        )

    return F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(start.alias("term"), start.alias("total")),
        step,
        lambda acc: acc["total"],
    )
