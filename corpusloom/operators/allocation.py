"""Evidence for lessons: chunks are given out in the lessons' order, and what is left is placed where it fits best.

Taking turns is a stable matching in which every chunk prefers the earlier lesson. So it is found in rounds over the whole table: each lesson asks for
its best chunks that haven't refused it, a chunk keeps the earliest lesson that has asked, and refuses all later ones at once. A round sees only pairs that
are still open, and no task holds a lesson's or a scope's chunks.

Defined results: a reusable chunk refuses nobody; repeated pairs count once, with their best score; ties go to the smaller chunk, and in placing to the
earlier lesson; a lesson or chunk that is null takes no part; without lessons nothing is placed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import Scratch, stage

#: Fixed value: chunks that a lesson gets at most.
CAPACITY = 12


def allocated(pairs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(lesson, chunk, score, rank) of pairs (lesson, chunk, score, reusable): lessons in order take their best chunks that no earlier one has taken."""
    c = F.col
    sound = pairs.where("lesson IS NOT NULL AND chunk IS NOT NULL").groupBy("lesson", "chunk").agg(F.max("score").alias("score"), F.coalesce(F.bool_or("reusable"), F.lit(False)).alias("reusable"))
    held = Scratch()
    open_ = held.stage(sound, "open-pairs")
    order = Window.partitionBy("lesson").orderBy(c("score").desc(), "chunk")
    while True:
        asked = open_.withColumn("rank", F.row_number().over(order)).where(c("rank") <= capacity)
        keeps = asked.where(~c("reusable")).groupBy("chunk").agg(F.min("lesson").alias("keeper"))
        turn = Scratch()
        keeps = turn.stage(keeps, "keepers")
        left = open_.join(keeps, "chunk", "left").where(c("reusable") | c("keeper").isNull() | (c("lesson") <= c("keeper"))).drop("keeper")
        left = turn.stage(left.select(open_.columns), "open-pairs")
        n, before = left.count(), open_.count()
        if n == before:
            found = stage(asked.select("lesson", "chunk", "score", "rank"), "allocated")
            held.clear()
            turn.clear()
            return found
        held.clear()
        held, open_ = turn, left


def placed_chunks(chunks: DataFrame, lessons: DataFrame, given: DataFrame) -> DataFrame:
    """(chunk, lesson, affinity) for each chunk (chunk, source, root, words) that isn't given to a lesson yet.

    Affinity is two for each word in common with a lesson (lesson, words), a quarter for a lesson that has a chunk (lesson, chunk) of the same source, and a half
    for one that has a chunk under the same root heading. A chunk for which nothing speaks goes to the first lesson, so all are placed."""
    c = F.col
    facts = chunks.where("chunk IS NOT NULL").select("chunk", "source", "root", F.array_distinct("words").alias("words"))
    rest = stage(facts.join(given.select("chunk").distinct(), "chunk", "left_anti"), "rest")
    known = given.select("lesson", "chunk").join(facts.select("chunk", "source", "root"), "chunk")
    of_source = stage(known.where("source IS NOT NULL").select("lesson", "source").distinct(), "of-source")
    of_root = stage(known.where("root IS NOT NULL").select("lesson", "root").distinct(), "of-root")
    spoken = lessons.where("lesson IS NOT NULL").select("lesson", F.explode(F.array_distinct("words")).alias("w"))
    shared = rest.select("chunk", F.explode("words").alias("w")).join(spoken, "w").groupBy("chunk", "lesson").agg((2.0 * F.count(F.lit(1))).alias("a"))
    # what has no word in common only needs the first lesson of its source and root, of its root, of its source, or of all
    both = of_source.join(of_root, "lesson").groupBy("source", "root").agg(F.min("lesson").alias("lesson"))
    first = lambda d, key: d.groupBy(key).agg(F.min("lesson").alias("lesson"))
    wanted = rest.select("chunk", "source", "root")
    others = [wanted.join(both, ["source", "root"]), wanted.join(first(of_root, "root"), "root"), wanted.join(first(of_source, "source"), "source")]
    start = lessons.agg(F.min("lesson").alias("lesson")).where("lesson IS NOT NULL")
    others.append(wanted.crossJoin(F.broadcast(start)))  # one row
    tried = shared
    for other in others:
        tried = tried.unionByName(other.select("chunk", "lesson", F.lit(0.0).alias("a")))
    tried = tried.groupBy("chunk", "lesson").agg(F.max("a").alias("a")).join(wanted, "chunk")
    tried = tried.join(of_source.withColumn("s", F.lit(0.25)), ["lesson", "source"], "left").join(of_root.withColumn("r", F.lit(0.5)), ["lesson", "root"], "left")
    total = c("a") + F.coalesce("s", F.lit(0.0)) + F.coalesce("r", F.lit(0.0))
    best = tried.groupBy("chunk").agg(F.min(F.struct((-total).alias("below"), "lesson")).alias("b"))
    return best.select("chunk", "b.lesson", (-c("b.below")).alias("affinity"))
