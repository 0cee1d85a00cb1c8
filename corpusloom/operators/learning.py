"""Learner state: ordered folds of answers, progress, locks, graph walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRUGGLING, MASTERED, PASS_SCORE = 0.3, 0.7, 0.7


def assessment_step(mastery: Column, score: Column, applied: Column) -> Column:
    """Mastery after an assessed answer; `applied` says that it was of a higher kind than recall."""
    moved = (
        F.when(score >= 0.85, mastery + F.when(applied, 0.25).otherwise(0.16) * (1 - mastery))
        .when(score >= 0.6, mastery + 0.10 * (1 - mastery))
        .when(score >= 0.25, mastery * 0.75)
        .otherwise(mastery * 0.60)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved))


#: Events of a learner and concept that are folded in one task: sequence numbers of one span.
SPAN = 4096


def _folded(events: DataFrame, factor: Column, add: Column, extra: dict[str, Column]) -> DataFrame:
    """(learner, concept, mastery, n_events and extra sums): mastery goes from 0 to m * factor + add at each event, in order of seq.

    Such steps compose to one of their kind. Spans of a history are composed apart, each in a task, then these few in order, so
    that a learner with a large share of all events meets in no one task. Mastery is rounded to nine digits, as orders of
    composition differ in the last ones.
    """
    pair = F.struct(factor.alias("f"), add.alias("a"))

    def compose(steps: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("f"), F.lit(0.0).alias("a"))
        return F.aggregate(
            F.array_sort(steps), start, lambda t, e: F.struct((t["f"] * e["s"]["f"]).alias("f"), (t["a"] * e["s"]["f"] + e["s"]["a"]).alias("a"))
        )

    sums = [F.count(F.lit(1)).alias("n_events"), *[v.alias(k) for k, v in extra.items()]]
    spans = events.groupBy("learner", "concept", F.floor(F.col("seq") / SPAN).alias("span")).agg(
        F.collect_list(F.struct("seq", pair.alias("s"))).alias("steps"), *sums
    )
    spans = spans.select("learner", "concept", "span", compose(F.col("steps")).alias("s"), "n_events", *extra)
    whole = spans.groupBy("learner", "concept").agg(
        compose(F.collect_list(F.struct("span", "s"))).alias("s"), *[F.sum(c).alias(c) for c in ("n_events", *extra)]
    )
    return whole.select("learner", "concept", F.round("s.a", 9).alias("mastery"), *extra, "n_events")


def fold_assessments(events: DataFrame) -> DataFrame:
    """(learner, concept, mastery, n_events) from events (learner, concept, seq, score, applied); order matters."""
    score, applied = F.col("score"), F.col("applied")
    gain = F.when(score >= 0.85, F.when(applied, 0.25).otherwise(0.16)).when(score >= 0.6, 0.10).otherwise(0.0)
    factor = F.when(gain > 0, 1 - gain).when(score >= 0.25, 0.75).otherwise(0.60)
    return _folded(events, factor, gain, {})


def fold_chat(events: DataFrame) -> DataFrame:
    """(learner, concept, mastery, n_struggled, n_events) from events (learner, concept, seq, op)."""
    op = F.col("op")
    factor = F.when(op == "demonstrated", 0.8).when(op == "struggled", 0.7).otherwise(1.0)
    return _folded(events, factor, F.when(op == "demonstrated", 0.2).otherwise(0.0), {"n_struggled": F.count_if(op == "struggled")})


def understood_and_struggling(state: DataFrame) -> DataFrame:
    """(learner, understood, struggling): sorted concept lists joined by commas."""
    pick = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("concept")))), ",")
    return state.groupBy("learner").agg(
        pick(F.col("mastery") >= MASTERED).alias("understood"),
        pick((F.col("mastery") <= STRUGGLING) & (F.col("n_struggled") > 0)).alias("struggling"),
    )


def progress(state: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per learner: mean mastery over all concepts, a missing one counting 0; how many are mastered; struggles."""
    n = concepts.agg(F.countDistinct("concept").alias("n_concepts"))  # one row of one number
    g = state.groupBy("learner").agg(
        F.sum("mastery").alias("m"), F.count_if(F.col("mastery") >= MASTERED).alias("n_mastered"), F.sum("n_struggled").alias("n_struggled")
    )
    mean = F.round(F.col("m") / F.col("n_concepts"), 6).alias("mean_mastery")
    return g.crossJoin(F.broadcast(n)).select("learner", mean, "n_mastered", "n_concepts", "n_struggled")


def weakest(state: DataFrame, n: int) -> DataFrame:
    """The n weakest concepts of each learner: by mastery, encounters, name."""
    w = Window.partitionBy("learner").orderBy("mastery", "n_events", "concept")
    return state.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def turns_since_progress(events: DataFrame) -> DataFrame:
    """(learner, seq, turns): rows since the last one that made progress."""
    w = Window.partitionBy("learner").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum(F.col("progressed").cast("int")).over(w)
    marked = events.select("learner", "seq", "progressed", island.alias("island"))
    run = Window.partitionBy("learner", "island").orderBy("seq")
    at = F.row_number().over(run) - F.when(F.col("island") > 0, 1).otherwise(0)
    return marked.select("learner", "seq", at.cast("bigint").alias("turns"))


def chapter_locks(attempts: DataFrame) -> DataFrame:
    """(learner, chapter, best, state): completed from PASS_SCORE on; available if first or after a completed one."""
    best = attempts.groupBy("learner", "chapter").agg(F.max("score").alias("best"))
    before = F.lag("best").over(Window.partitionBy("learner").orderBy("chapter"))
    state = F.when(F.col("best") >= PASS_SCORE, "completed").when(before.isNull() | (before >= PASS_SCORE), "available").otherwise("locked")
    return best.withColumn("state", state)


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, relation): the largest confidence, the union of evidence as a sorted list."""
    return edges.groupBy("source", "target", "relation").agg(
        F.max("confidence").alias("confidence"),
        F.array_join(F.array_sort(F.collect_set(F.col("evidence").cast("string"))), ",").alias("evidence"),
    )


def one_hop(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(seed, node, strength, rank): each seed's undirected neighbours, strongest first, `most` at most."""
    both = edges.select(F.col("source").alias("seed"), F.col("target").alias("node"), "confidence").unionByName(
        edges.select(F.col("target").alias("seed"), F.col("source").alias("node"), "confidence")
    )
    near = both.join(seeds.select(F.col("node").alias("seed")), "seed", "left_semi").groupBy("seed", "node").agg(F.max("confidence").alias("strength"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("strength"), "node"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most)


def prerequisites(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth): what each seed requires within `depth` steps, at the least depth. `depth` is a small constant."""
    e = edges.where("relation = 'requires'").select(F.col("source").alias("at"), F.col("target").alias("node")).distinct()
    step = seeds.select(F.col("node").alias("seed"), "node")
    found = None
    for d in range(1, depth + 1):
        step = step.withColumnRenamed("node", "at").join(e, "at").select("seed", "node").distinct()
        here = step.withColumn("depth", F.lit(d))
        found = here if found is None else found.unionByName(here)
    return found.where("seed != node").groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def reconcile(desired: DataFrame, existing: DataFrame, key: str, value: str) -> DataFrame:
    """(key, action): insert, update, keep or deactivate, by a full outer join."""
    d, e = desired.select(key, F.col(value).alias("new")), existing.select(key, F.col(value).alias("old"))
    joined = d.withColumn("has_new", F.lit(True)).join(e.withColumn("has_old", F.lit(True)), key, "full_outer")
    action = (
        F.when(F.col("has_old").isNull(), "insert").when(F.col("has_new").isNull(), "deactivate")
        .when(F.col("new").eqNullSafe(F.col("old")), "keep").otherwise("update")
    )
    return joined.select(key, action.alias("action"))
