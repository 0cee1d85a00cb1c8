"""A course for its player: chapters with nested lessons, blocks and quiz, state and progress; what a learner may open; attempts at quizzes.

A chapter is one row that holds its lessons and their blocks, as a player reads it: these are as many as a course plan has. What can be many for a
chapter (attempts, answers, mastery) is added up before it meets the chapter, and neighbours of chapters are found by their places, so that a
course of any size is spread.

Defined results: a chapter without lessons has an empty list, one without quiz a null quiz; questions that no check has are left out; concepts
without mastery count 0; a chapter without attempts has best score 0; equal places of chapters are told apart by title, then id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import let
from corpusloom.operators.ordering import placed
from corpusloom.operators.progress import mean, millionths
from corpusloom.session import stage

#: The score from which a chapter is passed, and what a lower one counts for progress, in tenths.
PASS_SCORE, UNPASSED_TENTHS = 0.7, 7


def _in_order(rows: DataFrame, key: str, name: str, order: list[str | Column], fields: list[str]) -> DataFrame:
    """(key, name): the fields of each key's rows as an array in the given order."""
    keyed = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_{i}") for i, o in enumerate(order)], F.struct(*fields).alias("r"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["r"]).alias(name))


def with_previous(chapters: DataFrame, value: str, first: bool = True) -> DataFrame:
    """chapters (course, chapter, at, title, value) with `previous`: the value of the chapter before, `first` for the first one."""
    at = placed(chapters.select("course", "chapter", "at", "title", value), "course", ["at", "title", "chapter"])
    at = stage(at.select("course", "chapter", value, "_at"), "places")
    before = at.select("course", (F.col("_at") + 1).alias("_at"), F.col(value).alias("previous"))
    found = at.join(before, ["course", "_at"], "left").select("course", "chapter", F.coalesce("previous", F.lit(first)).alias("previous"))
    return chapters.join(found, ["course", "chapter"])


def chapter_states(chapters: DataFrame, attempts: DataFrame, mastery: DataFrame) -> DataFrame:
    """chapters (course, chapter, at, title, concepts, opened) with n_attempts, best_score, state and progress, from attempts (chapter, score) and
    mastery (course, concept, mastery): completed from PASS_SCORE on, available if the chapter before is completed or it was opened, else locked."""
    best = attempts.groupBy("chapter").agg(F.count(F.lit(1)).alias("n_attempts"), F.max("score").alias("best_score"))
    known = mastery.select("course", "concept", millionths(F.col("mastery")).alias("m"))
    each = chapters.select("course", "chapter", F.explode("concepts").alias("concept")).join(known, ["course", "concept"], "left")
    means = each.groupBy("chapter").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n"))
    rows = chapters.join(best, "chapter", "left").join(means, "chapter", "left")
    rows = rows.withColumn("best_score", F.coalesce("best_score", F.lit(0.0))).withColumn("n_attempts", F.coalesce("n_attempts", F.lit(0)))
    rows = stage(rows.withColumn("completed", F.col("best_score") >= PASS_SCORE), "chapters")
    rows = with_previous(rows, "completed")
    state = F.when(F.col("completed"), "completed").when(F.col("previous") | F.coalesce("opened", F.lit(False)), "available").otherwise("locked")
    tenths = F.when(F.col("completed"), 10).otherwise(UNPASSED_TENTHS)
    counted = mean(millionths(F.col("best_score")) * tenths, F.lit(10))
    progress = F.greatest(F.coalesce(mean(F.col("total"), F.col("n")), F.lit(0.0)), counted)
    return rows.select(*chapters.columns, "n_attempts", "best_score", state.alias("state"), progress.alias("progress"))


def course_player(states: DataFrame, lessons: DataFrame, blocks: DataFrame, quizzes: DataFrame, checks: DataFrame, hints: DataFrame) -> DataFrame:
    """states with `lessons`, an array of (lesson, title, prerequisites, blocks of (block, kind, content)), and `quiz`, a struct (quiz, pass_score,
    questions of (check, prompt)) or null. Lessons come by the number of their prerequisites, then by place; blocks by place.

    lessons (chapter, lesson, at, title), blocks (lesson, block, at, kind, content), quizzes (chapter, quiz, pass_score, questions), checks
    (check, prompt), hints (lesson, prerequisites).
    """
    inner = _in_order(blocks, "lesson", "blocks", ["at", "block"], ["block", "kind", "content"])
    none = lambda column, like, name: F.coalesce(column, F.array().cast(like.schema[name].dataType))
    full = lessons.join(inner, "lesson", "left").join(hints.select("lesson", "prerequisites"), "lesson", "left")
    full = full.withColumn("blocks", none(F.col("blocks"), inner, "blocks"))
    full = full.withColumn("prerequisites", none(F.col("prerequisites"), hints, "prerequisites"))
    nested = _in_order(full, "chapter", "lessons", [F.size("prerequisites"), "at", "lesson"], ["lesson", "title", "prerequisites", "blocks"])
    asked = quizzes.select("chapter", F.posexplode("questions").alias("at", "check")).join(checks.select("check", "prompt"), "check")
    asked = _in_order(asked, "chapter", "asked", ["at"], ["check", "prompt"])
    quiz = quizzes.select("chapter", "quiz", "pass_score").join(asked, "chapter", "left")
    quiz = quiz.select("chapter", F.struct("quiz", "pass_score", none(F.col("asked"), asked, "asked").alias("questions")).alias("quiz"))
    rows = states.join(nested, "chapter", "left").join(quiz, "chapter", "left")
    return rows.select(*states.columns, none(F.col("lessons"), nested, "lessons").alias("lessons"), "quiz")


def access(chapters: DataFrame, lessons: DataFrame, quizzes: DataFrame, sequential: bool = True) -> tuple[DataFrame, DataFrame]:
    """What a learner may open, and nothing that gives answers away.

    chapters (course, chapter, at, title, ready), lessons (chapter, lesson, at, ready, completed), quizzes (chapter, passed): chapters with complete,
    locked and quiz_locked (null without quiz), and lessons (chapter, lesson, completed, locked). In sequence, a chapter opens when the quiz of the one
    before is passed, a lesson when the earlier ones of its chapter are completed, and a quiz when all lessons are; what was done stays open.
    """
    low = F.min(F.when(~F.col("completed"), F.struct("at", "lesson")))
    done = lessons.groupBy("chapter").agg(F.bool_or("completed").alias("some"), F.bool_and("completed").alias("all"), low.alias("first_open"))
    rows = chapters.join(quizzes.select("chapter", F.col("passed").alias("_passed")), "chapter", "left").join(done, "chapter", "left")
    rows = rows.withColumn("complete", F.coalesce("_passed", F.lit(False)))
    rows = with_previous(stage(rows, "access"), "complete") if sequential else rows.withColumn("previous", F.lit(True))
    some, every = F.coalesce("some", F.lit(False)), F.coalesce("all", F.lit(True))
    rows = stage(rows.withColumn("advance", F.col("ready") & F.col("previous")), "access")
    quiz = F.when(F.col("_passed").isNotNull(), ~(F.col("complete") | (F.col("advance") & every)))
    locked = ~(F.col("ready") & (F.col("advance") | some | F.col("complete")))
    own = rows.select("chapter", "advance", "first_open")
    at_first = F.col("first_open").isNull() | (F.struct("at", "lesson") <= F.col("first_open"))
    may = F.col("completed") | (F.lit(True) if not sequential else F.col("advance") & at_first)
    inner = lessons.join(own, "chapter").select("chapter", "lesson", "completed", (~(F.col("ready") & may)).alias("locked"))
    return rows.select(*chapters.columns, "complete", locked.alias("locked"), quiz.alias("quiz_locked")), inner


def quiz_attempts(quizzes: DataFrame, answers: DataFrame, checks: DataFrame, correct: Column) -> DataFrame:
    """(attempt, chapter, n_answered, n_correct, score, passed) of answers (attempt, chapter, check, answer) to quizzes (chapter, pass_score,
    questions): `correct` judges an answer against its check's columns; questions without an answer count in the total, answers to others don't."""
    asked = quizzes.select("chapter", "pass_score", F.size("questions").alias("total"), F.explode("questions").alias("check"))
    judged = answers.join(asked, ["chapter", "check"]).join(checks, "check").groupBy("attempt", "chapter", "pass_score", "total")
    found = judged.agg(F.count(F.lit(1)).alias("n_answered"), F.count_if(correct).alias("n_correct"))
    score = mean(F.col("n_correct") * 1_000_000, F.greatest("total", F.lit(1)))
    return found.select("attempt", "chapter", "n_answered", "n_correct", score.alias("score"), (score >= F.col("pass_score")).alias("passed"))


def adhoc_attempt(questions: DataFrame, answers: DataFrame, concepts: DataFrame, correct: Column) -> DataFrame:
    """(attempt, total, n_resolved, score) of questions (attempt, at, label, …), answers (attempt, at, answer) by place, and concepts (label, concept):
    every question counts in the total; those without an answer or with an unknown label give no result."""
    both = questions.join(answers, ["attempt", "at"], "left").join(concepts.dropDuplicates(["label"]), "label", "left")
    resolved = F.col("answer").isNotNull() & F.col("concept").isNotNull()
    return both.groupBy("attempt").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(resolved).alias("n_resolved"), F.count_if(resolved & correct).alias("score")
    )


#: Kinds of blocks that are prose; the length from which a text can't repeat a shorter one, fewest words, and the common share of words.
PROSE = ("markdown", "definition", "example", "procedure", "warning", "summary")
LONGER, LEAST_WORDS, COMMON = 1.15, 8, 0.92


def _repeats(new: Column, old: Column) -> Column:
    """Whether a prose block says what an earlier one says; both are (norm, words, distinct)."""
    common = F.size(F.array_intersect(new["distinct"], old["distinct"]))
    enough = F.least(F.size(new["words"]), F.size(old["words"])) >= LEAST_WORDS
    near = enough & (common >= COMMON * F.size(new["distinct"]))
    return (new["norm"] != "") & (old["norm"] != "") & (F.length(new["norm"]) <= F.length(old["norm"]) * LONGER) & (F.contains(old["norm"], new["norm"]) | near)


def distinct_blocks(blocks: DataFrame, norm: Column) -> DataFrame:
    """The blocks (lesson, block, at, kind, content) that stay: none without content, none that an earlier one of its kind equals, no prose that an
    earlier kept one holds, or nearly holds. `norm` is the wording that is compared. Equal ones go by a shuffle; what is left of a lesson is
    looked through in its row, as it is shown."""
    kind = F.coalesce("kind", F.lit("markdown"))
    d = blocks.where(F.trim(F.coalesce("content", F.lit(""))) != "").select(*blocks.columns, kind.alias("_kind"), norm.alias("_norm"))
    one = d.groupBy("lesson", "_kind", "_norm").agg(F.min(F.struct("at", "block")).alias("r"))
    words = F.filter(F.split("_norm", " "), lambda w: w != "")
    prose = one.where(F.col("_kind").isin(*PROSE)).select("lesson", F.struct("r.at", "r.block", F.col("_norm").alias("norm"), words.alias("words"), F.array_distinct(words).alias("distinct")).alias("b"))
    rows = prose.groupBy("lesson").agg(F.array_sort(F.collect_list("b")).alias("rows"))
    kept = F.aggregate("rows", F.slice("rows", 1, 0), lambda done, b: F.when(F.exists(done, lambda o: _repeats(b, o)), done).otherwise(F.concat(done, F.array(b))))
    kept = rows.select("lesson", F.explode(let(kept, lambda k: F.transform(k, lambda b: b["block"]))).alias("block"))
    other = one.where(~F.col("_kind").isin(*PROSE)).select("lesson", "r.block")
    return blocks.join(kept.unionByName(other), ["lesson", "block"], "left_semi")
