"""Progress of learners over concepts, objectives and phases; quizzes, checks and review windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASTERED = 0.7
BLOOM = ("remember", "understand", "apply", "analyze")
CHECK_TYPES = ("mcq", "true_false", "fill_blank", "short_answer")


def millionths(value: Column) -> Column:
    """value in whole millionths: sums of these don't depend on their order."""
    return F.round(value * 1_000_000).cast("bigint")


def mean(total: Column, n: Column, unit: int = 1) -> Column:
    """total / (unit * n), both whole, total in millionths: halves at the sixth digit go up, decided by whole numbers."""
    half = F.lit(unit).cast("bigint") * n
    whole = 2 * total + half
    return ((whole - F.pmod(whole, 2 * half)) / (2 * half)).cast("bigint") / 1_000_000


def objective_progress(state: DataFrame, objectives: DataFrame) -> DataFrame:
    """(learner, objective, phase, mastery, encounters, struggles) of state (learner, concept, mastery, encounters, struggles) and
    objectives (objective, phase, concept): the mean over all concepts of an objective, unknown ones counting 0."""
    sizes = objectives.groupBy("objective", "phase").agg(F.count(F.lit(1)).alias("n"))
    sums = state.join(objectives, "concept").groupBy("learner", "objective").agg(
        F.sum(millionths(F.col("mastery"))).alias("m"), F.sum("encounters").alias("encounters"), F.sum("struggles").alias("struggles")
    )
    return sums.join(sizes, "objective").select("learner", "objective", "phase", mean(F.col("m"), F.col("n")).alias("mastery"), "encounters", "struggles")


def phase_progress(progress: DataFrame, objectives: DataFrame) -> DataFrame:
    """(learner, phase, mastery, total, mastered, struggles): the mean over all objectives of a phase."""
    totals = objectives.groupBy("phase").agg(F.countDistinct("objective").alias("total"))
    sums = progress.groupBy("learner", "phase").agg(
        F.sum(millionths(F.col("mastery"))).alias("m"), F.count_if(F.col("mastery") >= MASTERED).alias("mastered"), F.sum("struggles").alias("struggles")
    )
    return sums.join(totals, "phase").select("learner", "phase", mean(F.col("m"), F.col("total")).alias("mastery"), "total", "mastered", "struggles")


def concepts_of_weakest(progress: DataFrame, objectives: DataFrame, n: int) -> DataFrame:
    """(learner, concept, pos): concepts of the weakest objectives first - mastery, encounters, objective - each once, n a learner."""
    rank = F.row_number().over(Window.partitionBy("learner").orderBy("mastery", "encounters", "objective"))
    ranked = progress.select("learner", "objective", rank.alias("r")).where(F.col("r") <= n)  # every objective has a concept
    first = ranked.join(objectives, "objective").groupBy("learner", "concept").agg(F.min(F.struct("r", "concept")).alias("at"))
    pos = F.row_number().over(Window.partitionBy("learner").orderBy("at"))
    return first.select("learner", "concept", pos.alias("pos")).where(F.col("pos") <= n)


def local_state(events: DataFrame) -> DataFrame:
    """(learner, concept, mastery, understood, struggling) of events (learner, concept, seq, op), op covered, demonstrated or struggled.

    Covering sets 0.15 once, demonstrating raises to 0.75, struggling lowers to 0.35. Only the first and the last event and whether there
    was a demonstration matter, so partial aggregates are enough whatever the length of a history.
    """
    demonstrated, struggled = F.col("op") == "demonstrated", F.col("op") == "struggled"
    g = events.groupBy("learner", "concept").agg(
        F.min_by("op", "seq").alias("first"), F.max(F.when(demonstrated, F.col("seq"))).alias("d"), F.max(F.when(struggled, F.col("seq"))).alias("s")
    )
    d, s = F.col("d"), F.col("s")
    low = F.when(d.isNull() & (F.col("first") == "covered"), 0.15).otherwise(0.35)
    mastery = F.when(d.isNull() & s.isNull(), 0.15).when(s.isNull() | (d > s), 0.75).otherwise(low)
    return g.select("learner", "concept", mastery.alias("mastery"), d.isNotNull().alias("understood"), (s.isNotNull() & (d.isNull() | (s > d))).alias("struggling"))


def migrate_labels(legacy: DataFrame, concepts: DataFrame, current: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """Scores by label (learner, label, score) moved to concepts (concept, name): the largest of old and current (learner, concept, mastery);
    and the labels that match no name. Names and labels match by `key`."""
    known = concepts.select("concept", key(F.col("name")).alias("key"))
    matched = legacy.withColumn("key", key(F.col("label"))).join(known, "key", "left")
    moved = matched.where("concept IS NOT NULL").select("learner", "concept", F.col("score").alias("mastery"))
    best = moved.unionByName(current.select("learner", "concept", "mastery")).groupBy("learner", "concept").agg(F.max("mastery").alias("mastery"))
    return best, matched.where("concept IS NULL").select("learner", "label", "score")


def check_type(index: Column, bloom: Column) -> Column:
    """Types in rotation; a short answer for levels that apply or analyse."""
    turn = F.get(F.array(*map(F.lit, CHECK_TYPES)), F.pmod(index, F.lit(len(CHECK_TYPES))).cast("int"))
    return F.when(bloom.isin("apply", "analyze"), "short_answer").otherwise(turn)


def stretch(bloom: Column) -> Column:
    """The next harder level."""
    levels = F.array(*map(F.lit, BLOOM))
    return F.get(levels, F.least(F.array_position(levels, bloom), F.lit(len(BLOOM) - 1)).cast("int"))


def grade_all(questions: DataFrame, answers: DataFrame, pass_score: float = 0.7) -> DataFrame:
    """(quiz, total, answered, correct, score, passed) of questions (quiz, question, expected) and answers (quiz, question, answer): a
    question without an answer is wrong and counts in the total."""
    both = questions.join(answers, ["quiz", "question"], "left")
    right = F.coalesce(F.col("answer") == F.col("expected"), F.lit(False))
    g = both.groupBy("quiz").agg(F.count(F.lit(1)).alias("total"), F.count("answer").alias("answered"), F.count_if(right).alias("correct"))
    score = F.round(F.col("correct") / F.col("total"), 6)
    return g.withColumn("score", score).withColumn("passed", F.col("score") >= pass_score)


def merge_quiz_progress(attempts: DataFrame) -> DataFrame:
    """(learner, quiz, n_attempts, score): attempts counted, the best score kept."""
    return attempts.groupBy("learner", "quiz").agg(F.count(F.lit(1)).alias("n_attempts"), F.max("score").alias("score"))


def locked_after_unpassed(attempts: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(learner, chapter, passed, locked): a chapter is open if it is the first, the one before has a passed attempt, or an override
    (learner, chapter) opens it."""
    p = attempts.groupBy("learner", "chapter").agg(F.bool_or("passed").alias("passed"))
    before = F.lag("passed").over(Window.partitionBy("learner").orderBy("chapter"))
    p = p.withColumn("locked", ~F.coalesce(before, F.lit(True)))
    if overrides is None:
        return p
    o = overrides.distinct().withColumn("opened", F.lit(True))
    return p.join(o, ["learner", "chapter"], "left").select("learner", "chapter", "passed", (F.col("locked") & F.col("opened").isNull()).alias("locked"))


def window_due(status: Column, answered: Column, snooze_until: Column, due_count: Column) -> Column:
    """Pending and started windows are due, snoozed ones from their count on, others never."""
    return F.when(status.isin("pending", "started"), True).when(status == "snoozed", answered >= F.coalesce(snooze_until, due_count)).otherwise(False)


def question_count(concepts: Column, objectives: Column, chunks: Column) -> Column:
    """Three, five or seven questions by the richness of a window, no more than concepts."""
    richness = F.greatest(concepts, objectives, F.floor(chunks / 2))
    return F.least(concepts, F.when(richness <= 3, 3).when(richness >= 7, 7).otherwise(5))


def scoped_or_all(chunks: DataFrame, wanted: DataFrame, scope: str, item: str) -> DataFrame:
    """Of each scope's chunks those that are wanted (item); all of them where none is."""
    marked = chunks.join(wanted.select(item, F.lit(True).alias("_in")).distinct(), item, "left")
    some = marked.groupBy(scope).agg(F.count("_in").alias("_n"))
    return marked.join(some, scope).where((F.col("_n") == 0) | F.col("_in")).select(chunks.columns)


def coverage(covered: DataFrame, total: DataFrame, scope: str, item: str) -> DataFrame:
    """(scope, n_total, n_covered, ratio): distinct items of the total, and those of them that are covered."""
    t, c = total.select(scope, item).distinct(), covered.select(scope, item, F.lit(1).alias("hit")).distinct()
    g = t.join(c, [scope, item], "left").groupBy(scope).agg(F.count(F.lit(1)).alias("n_total"), F.count("hit").alias("n_covered"))
    return g.withColumn("ratio", F.round(F.col("n_covered") / F.col("n_total"), 6))


def ordered_distinct(rows: DataFrame, key: str, order: str, arrays: list[str], most: int = 200) -> DataFrame:
    """(key, one column for each of arrays): the elements of a key's arrays in the rows' order, each at its first place, `most` at most."""
    found = rows.select(key).distinct()
    for name in arrays:
        each = rows.select(key, order, F.posexplode(name).alias("at", "x")).groupBy(key, "x").agg(F.min(F.struct(order, "at")).alias("first"))
        top = each.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("first"))).where(F.col("r") <= most)
        lists = top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "x"))), lambda s: s["x"]).alias(name))
        found = found.join(lists, key, "left")
    return found
