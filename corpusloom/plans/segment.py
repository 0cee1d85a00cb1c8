"""Semantic chunks of the driver's documents. A sequential cut can't be said in SQL: tests compare it with a plain second version."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators import semantic as S
from corpusloom.plans.registry import _docs, query


@query()
def semantic_chunks(spark, sf):
    """By common terms of neighbouring units."""
    found = S.semantic_chunks(_docs(spark, sf))
    return found.select("doc_id", "chunk", "boundary", "likeness", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query()
def semantic_chunks_of_vectors(spark, sf):
    """By vectors of units: here counts of terms in 32 hash ranges."""
    docs = _docs(spark, sf).where("doc_id IS NOT NULL")
    places = F.transform(tokens(F.col("text")), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(32)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.size(F.filter("places", lambda p: p == k)).cast("double"))
    u = S.semantic_units(docs).select("doc_id", "unit", places.alias("places"))
    found = S.semantic_chunks(docs, u.select("doc_id", "unit", counts.alias("embedding")))
    return found.select("doc_id", "chunk", "boundary", "likeness", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))
