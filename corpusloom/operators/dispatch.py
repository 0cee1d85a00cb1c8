"""Context for outputs of any kind: each request takes its own route over the chunks of its scope.

full: quizzes and mind maps get every chunk, then what the graph gives for them. sample: outputs of a whole course without a topic, or questions that
ask for the course itself, get the first chunks of its sections. fused: everything else gets its ranked lists, any number of them, fused by rank; what the
graph found comes first, neighbours in the section come after, and a request that no list answers gets the sample.

A route's joins see its own requests only, so that a list is ranked for those who ask for it and a route that nobody takes costs nothing.
Requests meet chunks by scope; what a scope has is what its request gets, so no row is made that isn't asked for.

Defined results: a chunk stands once, at its first place; ties go to the smaller chunk; chunks that say nothing are left out but on the full
route, unless a scope has no others; a null topic or message is empty; requests without a scope or output, and empty scopes, get nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.context import MODES, overview_question
from corpusloom.operators.retrieval import reciprocal_rank_fusion, top_k

#: Outputs that take a whole selection, those that take a sample without a topic, and the modes that need a question.
WHOLE, BROAD = ("quiz", "mindmap"), ("quiz", "mindmap", "presentation", "podcast")
BROAD_MODES = ("coverage_broad", "narrative_arc", "topic_clusters")
FULL, SAMPLE, FUSED = "full", "sample", "fused"


def question(topic: Column, message: Column) -> Column:
    """The topic, or else the message."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.when(blank(topic) != "", blank(topic)).otherwise(blank(message))


def route(output: Column, topic: Column, message: Column) -> Column:
    """full, sample or fused."""
    asked = question(topic, message)
    mode = F.create_map(*[F.lit(x) for pair in MODES.items() for x in pair])[output]
    untold = output.isin(*BROAD) & (F.trim(F.coalesce(topic, F.lit(""))) == "")
    overview = output.isin("text", "chat") & overview_question(asked)
    return F.when(output.isin(*WHOLE), FULL).when(untold | overview | (mode.isin(*BROAD_MODES) & (asked == "")), SAMPLE).otherwise(FUSED)


def dispatched(requests: DataFrame) -> DataFrame:
    """requests (request_id, scope, output_type, topic, message) with their route and question."""
    c = F.col
    rows = requests.where("request_id IS NOT NULL AND scope IS NOT NULL AND output_type IS NOT NULL")
    return rows.select("request_id", "scope", "output_type", route(c("output_type"), c("topic"), c("message")).alias("route"), question(c("topic"), c("message")).alias("question"))


def _telling(chunks: DataFrame) -> DataFrame:
    """Chunks that say something; all of a scope's where none does."""
    some = chunks.groupBy("scope").agg(F.bool_and("low").alias("all_low"))
    return chunks.join(some, "scope").where("all_low OR NOT low").drop("all_low")


def _sample(requests: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """(request_id, chunk_id, at): the first chunks of the sections, then others, in their order."""
    first = F.row_number().over(Window.partitionBy("scope", "section").orderBy("at", "chunk_id")) > 1
    rank = F.row_number().over(Window.partitionBy("scope").orderBy("later", "at", "chunk_id"))
    best = chunks.join(requests.select("scope").distinct(), "scope", "left_semi").withColumn("later", first).withColumn("r", rank).where(F.col("r") <= most)
    return best.join(requests.select("request_id", "scope"), "scope").select("request_id", "chunk_id", "at")


def contexts(requests: DataFrame, chunks: DataFrame, lists: list[DataFrame], graph: DataFrame, k: int = 8, most_sampled: int = 12, most_graph: int = 4) -> DataFrame:
    """(request_id, route, pos, chunk_id, origin) for dispatched requests.

    chunks (scope, chunk_id, at, section, low); lists of (request_id, chunk_id, rank), and what the graph gives likewise. origin is full, graph, sample, list or
    neighbour."""
    c = F.col
    by = {r: requests.where(c("route") == r) for r in (FULL, SAMPLE, FUSED)}
    part = lambda d, step, at, origin: d.select("request_id", F.lit(step).alias("step"), at.cast("bigint").alias("at"), "chunk_id", F.lit(origin).alias("origin"))
    whole = by[FULL].select("request_id", "scope").join(chunks, "scope")
    told = _telling(chunks)
    related = lambda r: graph.join(by[r].select("request_id"), "request_id", "left_semi")
    fused = top_k(reciprocal_rank_fusion(*(x.join(by[FUSED].select("request_id"), "request_id", "left_semi").toDF("query_id", "doc_id", "rank") for x in lists)), k)
    hits = fused.select(c("query_id").alias("request_id"), c("doc_id").alias("chunk_id"), "rank")
    near = hits.join(by[FUSED].select("request_id", "scope"), "request_id").join(told.select("scope", "chunk_id", "at", "section"), ["scope", "chunk_id"])
    steps = near.select("request_id", "scope", "section", "rank", "at", F.explode(F.array(F.lit(-1), F.lit(1))).alias("d")).withColumn("at", c("at") + c("d"))
    beside = steps.join(told.select("scope", "section", "at", "chunk_id"), ["scope", "section", "at"]).select("request_id", "chunk_id", (c("rank") * 2 + (c("d") + 1) / 2).alias("rank"))
    unanswered = by[FUSED].join(hits.select("request_id").distinct(), "request_id", "left_anti")
    sampled = _sample(by[SAMPLE].unionByName(unanswered), told, most_sampled)
    parts = [
        part(whole, 0, c("at"), "full"), part(related(FULL), 1, c("rank"), "graph"), part(sampled, 2, c("at"), "sample"),
        part(related(FUSED).where(c("rank") <= most_graph).join(hits.select("request_id").distinct(), "request_id", "left_semi"), 3, c("rank"), "graph"),
        part(hits, 4, c("rank"), "list"), part(beside, 5, c("rank"), "neighbour"),
    ]
    first = reduce(DataFrame.unionByName, parts).groupBy("request_id", "chunk_id").agg(F.min(F.struct("step", "at", "origin")).alias("f"))
    pos = F.row_number().over(Window.partitionBy("request_id").orderBy("f.step", "f.at", "chunk_id"))
    return first.join(requests.select("request_id", "route"), "request_id").select("request_id", "route", pos.alias("pos"), "chunk_id", c("f.origin").alias("origin"))
