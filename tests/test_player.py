"""Hand-made cases of course players."""

from pyspark.sql import functions as F

from corpusloom.functions.text import concept_key
from corpusloom.operators import player as P

CHAPTERS = "course int, chapter int, at int, title string, concepts array<int>, opened boolean"


def test_states_and_nesting(spark):
    chapters = spark.createDataFrame([(1, 1, 0, "a", [1, 2], False), (1, 2, 1, "b", [3], False), (1, 3, 2, "c", [], False), (1, 4, 3, "d", [1], True), (2, 9, 0, "z", [7], None)], CHAPTERS)
    attempts = spark.createDataFrame([(1, 0.5), (1, 0.8), (2, 0.6), (77, 1.0)], "chapter int, score double")
    mastery = spark.createDataFrame([(1, 1, 0.9), (1, 3, 0.2)], "course int, concept int, mastery double")
    states = P.chapter_states(chapters, attempts, mastery)
    got = {r.chapter: (r.n_attempts, r.best_score, r.state, r.progress) for r in states.collect()}
    assert got == {1: (2, 0.8, "completed", 0.8), 2: (1, 0.6, "available", 0.42), 3: (0, 0.0, "locked", 0.0), 4: (0, 0.0, "available", 0.9), 9: (0, 0.0, "available", 0.0)}
    lessons = spark.createDataFrame([(1, 10, 0, "x"), (1, 11, 1, "y"), (2, 12, 0, "w")], "chapter int, lesson int, at int, title string")
    blocks = spark.createDataFrame([(10, 5, 1, "example", "e"), (10, 6, 0, "definition", "d")], "lesson int, block int, at int, kind string, content string")
    quizzes = spark.createDataFrame([(1, 100, 0.7, [8, 404, 7]), (2, 200, 0.7, [404])], "chapter int, quiz int, pass_score double, questions array<int>")
    checks = spark.createDataFrame([(7, "q7"), (8, "q8")], "check int, prompt string")
    hints = spark.createDataFrame([(10, [3])], "lesson int, prerequisites array<int>")
    p = {r.chapter: r for r in P.course_player(states, lessons, blocks, quizzes, checks, hints).collect()}
    assert [(x.lesson, [b.block for b in x.blocks], x.prerequisites) for x in p[1].lessons] == [(11, [], []), (10, [6, 5], [3])]
    assert [q.check for q in p[1].quiz.questions] == [8, 7] and p[2].quiz.questions == [] and p[3].quiz is None and p[9].lessons == []


def test_access(spark):
    chapters = spark.createDataFrame([(1, c, c, "t", c != 4) for c in (1, 2, 3, 4)], "course int, chapter int, at int, title string, ready boolean")
    lessons = spark.createDataFrame(
        [(1, 10, 0, True, True), (1, 11, 1, True, False), (1, 12, 2, True, False), (2, 20, 0, True, False), (3, 30, 0, False, True)],
        "chapter int, lesson int, at int, ready boolean, completed boolean",
    )
    quizzes = spark.createDataFrame([(1, False), (2, True), (4, False)], "chapter int, passed boolean")
    own, inner = P.access(chapters, lessons, quizzes)
    assert {r.chapter: (r.complete, r.locked, r.quiz_locked) for r in own.collect()} == {
        1: (False, False, True), 2: (True, False, False), 3: (False, False, None), 4: (False, True, True),
    }
    assert {r.lesson: r.locked for r in inner.collect()} == {10: False, 11: False, 12: True, 20: True, 30: True}
    assert {r.lesson: r.locked for r in P.access(chapters, lessons, quizzes, sequential=False)[1].collect()} == {10: False, 11: False, 12: False, 20: False, 30: True}


def test_attempts(spark):
    quizzes = spark.createDataFrame([(1, 0.6, [1, 2, 3])], "chapter int, pass_score double, questions array<int>")
    answers = spark.createDataFrame([(5, 1, 1, "a"), (5, 1, 2, "b"), (6, 1, 1, "x"), (6, 1, 9, "z")], "attempt int, chapter int, check int, answer string")
    checks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (9, "z")], "check int, expected string")
    got = {r.attempt: (r.n_answered, r.n_correct, r.score, r.passed) for r in P.quiz_attempts(quizzes, answers, checks, F.col("answer") == F.col("expected")).collect()}
    assert got == {5: (2, 2, 0.666667, True), 6: (1, 0, 0.0, False)}
    asked = spark.createDataFrame([(1, 0, "A", 1), (1, 1, "B", 1), (1, 2, "?", 1), (2, 0, "A", 0)], "attempt int, at int, label string, expected int")
    given = spark.createDataFrame([(1, 0, 1), (1, 2, 1)], "attempt int, at int, answer int")
    known = spark.createDataFrame([("A", 1), ("B", 2)], "label string, concept int")
    found = P.adhoc_attempt(asked, given, known, F.col("answer") == F.col("expected")).collect()
    assert {r.attempt: (r.total, r.n_resolved, r.score) for r in found} == {1: (3, 1, 1), 2: (1, 0, 0)}


def test_repeated_prose_goes(spark):
    long = "the cell divides in two equal parts and each part has the same core"
    rows = [
        (1, 1, 0, "markdown", f"<p>{long}</p>"), (1, 2, 1, "definition", "Each part has the same core."), (1, 3, 2, "example", long + " again"), (1, 4, 3, "example", long + " and many other words that say more"),
        (1, 5, 4, "table", long), (1, 6, 5, "table", long.upper()), (1, 7, 6, None, " "), (1, 8, 7, "warning", "part same"), (2, 9, 0, "summary", long), (2, 10, 1, None, None),
    ]
    d = spark.createDataFrame(rows, "lesson int, block int, at int, kind string, content string")
    norm = concept_key(F.regexp_replace("content", "<[^>]+>", " "))
    assert sorted(r.block for r in P.distinct_blocks(d, norm).collect()) == [1, 4, 5, 8, 9]
    assert P.distinct_blocks(d.limit(0), norm).count() == 0
