"""Exact dedup: a persistent digest index, bucketed and sorted by hash, met by sort-merge anti-joins.

Texts are equal when they are identical after lower-casing A-Z; a null text counts as the empty one. Of equal texts in
one batch the row with the largest doc_id stays; a text that an earlier batch has brought is a copy of that batch's row.

Defined results: an empty table gives no rows; rows that repeat both doc_id and text are the same document, so each is
returned with the same verdict and counted in group_size; a null doc_id never outranks another and stays only where all
ids of its group are null; every other column of the input is ignored, whatever its name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, new_path, partitions, stage, table, without

#: Groups with at least this share of all rows are joined by broadcast: there can be no more than its inverse of them.
HOT_SHARE = 1 / 200


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text as 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """Table (digest, keep_id), bucketed and sorted by digest, one row for each distinct text seen so far.

    The table lives under `path` and is registered in the session's catalog; open an existing one by giving the path and
    the bucket count with which it was made.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "digest-index")
        self.buckets = buckets or partitions(spark)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet LOCATION '{self.path}' "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, batch: DataFrame) -> DataFrame:
        """Anti-join a batch (digest, keep_id) of distinct digests with the index, append what is new, return it."""
        fresh = stage(batch.join(self.table().hint("merge"), "digest", "left_anti"), "digest-fresh")
        # one task for each bucket writes one sorted file
        fresh.select("digest", "keep_id").repartition(self.buckets, "digest").sortWithinPartitions(
            "digest"
        ).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return fresh


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Verdicts for a batch: (doc_id, keep_id, group_size, kept, text_sha256), one row for each input row.

    Only ids and digests move. The batch's groups are counted with map-side combining, anti-joined with the index and
    appended to it; then the ids look their group up: the few groups that may hold a large share of the rows by
    broadcast, all others by sort-merge join with the bucketed table.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    digests = stage(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest(F.col("text")).alias("digest")),
        "digests",
    )
    groups = stage(
        digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups"
    )
    index.append(groups)
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = groups.where(F.col("group_size") > F.lit(max(1, int(total * HOT_SHARE))))
    held = index.table()
    known = lambda g: g.select("digest", "group_size").join(held.hint("merge"), "digest")
    tagged = digests.join(F.broadcast(known(hot)), "digest", "left")
    cold = tagged.where(F.col("group_size").isNull()).select("digest", "doc_id")
    rest = groups.where(F.col("group_size") <= F.lit(max(1, int(total * HOT_SHARE))))
    found = cold.hint("merge").join(known(rest), "digest")
    columns = ["doc_id", "keep_id", "group_size", "digest"]
    both = tagged.where(F.col("group_size").isNotNull()).select(columns).unionByName(found.select(columns))
    return both.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns. Rows are known by doc_id and digest: what is to go is
    anti-joined with the rows, broadcast where it is few by its count; of rows that repeat both one stays."""
    found = exact_dedup(docs).where("group_size > 1")
    counted = found.groupBy("doc_id", F.unhex("text_sha256").alias("key"), F.col("kept").alias("keep")).agg(F.count(F.lit(1)).alias("rows"))
    verdicts = stage(counted.where("not keep or rows > 1").select("doc_id", "key", "keep"), "copies")
    return without(docs, text_digest(F.col("text")), verdicts)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op5_exact_dedup": """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM n"""
}
