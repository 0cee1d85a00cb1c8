"""Mind maps of course texts that Spark derives from orders and customers. Stack machines and greedy placing are beyond SQL: tests hold them by hand and
against a plain second version."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import mindmaps as M
from corpusloom.operators import structure as S
from corpusloom.plans.course import _sections, course_texts
from corpusloom.plans.registry import query, stage


@query()
def outline_mind_map(spark, sf):
    return M.outline_maps(course_texts(spark, sf), 40)


@query()
def module_mind_map(spark, sf):
    """A scope is eight neighbouring customers; their courses are its modules, every fifth a supporting one, and their concepts its graph."""
    scope = F.floor(F.col("doc_id") / 8)
    s = stage(_sections(spark, sf).select(scope.alias("scope"), "doc_id", "section", "level", "title", "text", S.key_concepts(F.col("text")).alias("names")), "sections")
    heads = F.transform(F.array_sort(F.collect_list(F.struct("section", "title"))), lambda x: F.array(x["title"]))
    dated = F.transform(F.array_sort(F.collect_list(F.struct("section", S.summary(F.col("text")).alias("t")))), lambda x: x["t"])
    modules = s.groupBy("scope", "doc_id").agg(heads.alias("paths"), dated.alias("details"), F.min_by("title", "section").alias("first"))
    role = F.when(F.col("doc_id") % 5 == 4, "supporting").otherwise("main")
    title = F.concat(F.lit("Course "), F.col("doc_id").cast("string"), F.lit(": "), F.col("first"))
    modules = modules.select("scope", F.col("doc_id").alias("rank"), role.alias("role"), title.alias("title"), "paths", "details")
    named = s.select("scope", "doc_id", "section", "text", F.explode("names").alias("name"))
    nodes = named.groupBy("scope", "name").agg(F.count(F.lit(1)).alias("n_sources"), F.min_by("text", F.struct("doc_id", "section")).alias("evidence"))
    kind = F.when(F.lower("name").contains("total"), "formula").otherwise("concept")
    nodes = nodes.select("scope", F.col("name").alias("id"), kind.alias("kind"), "name", F.lit(None).cast("string").alias("description"), F.left("evidence", F.lit(500)).alias("evidence"), "n_sources")
    both = named.select("scope", "doc_id", "section", F.col("name").alias("source")).join(named.select("scope", "doc_id", "section", F.col("name").alias("target")), ["scope", "doc_id", "section"])
    edges = both.where("source < target").groupBy("scope", "source", "target").agg(F.count(F.lit(1)).alias("n")).select(
        "scope", "source", "target", F.lit("explains").alias("relation"), (1 - 0.3 / F.col("n")).alias("confidence")
    )
    return M.module_maps(modules, nodes, edges, 60, course_texts(spark, sf).where(F.col("doc_id") % 8 == 0).select((F.col("doc_id") / 8).cast("bigint").alias("doc_id"), "text"))
