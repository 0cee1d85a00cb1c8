"""Course players on the driver's tables, with DuckDB SQL for the same results: customers stand for courses, orders for chapters, their numbered lines
for lessons, single lines for blocks; suppliers in thirteen classes are concepts and events attempts at the order with their number."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import concept_key
from corpusloom.operators import player as P
from corpusloom.operators.progress import mean, millionths
from corpusloom.plans.registry import query, table


def _chapters(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")  # noqa: E741
    own = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_suppkey") % 13).alias("concepts"))
    title = F.concat(F.lit("Orders "), F.substring("o_orderpriority", 3, 40))
    return o.join(own, "o_orderkey", "left").select(
        F.col("o_custkey").alias("course"), F.col("o_orderkey").alias("chapter"), F.col("o_orderdate").alias("at"), title.alias("title"),
        F.coalesce("concepts", F.array().cast("array<bigint>")).alias("concepts"), (F.col("o_orderkey") % 9 == 0).alias("opened"), (F.col("o_orderstatus") != "P").alias("ready"),
    )


def _attempts(spark, sf):
    return table(spark, sf, "events").select((F.col("event_id") - F.col("event_id") % 2).alias("chapter"), F.least(F.lit(1.0), F.col("value") / 100).alias("score"))


def _mastery(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")  # noqa: E741
    each = l.where("l_suppkey % 13 <> 3").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    g = each.groupBy(F.col("o_custkey").alias("course"), (F.col("l_suppkey") % 13).alias("concept"))
    return g.agg(F.sum(millionths(F.col("l_quantity"))).alias("t"), F.count(F.lit(1)).alias("n")).select("course", "concept", mean(F.col("t"), F.col("n"), 50).alias("mastery"))


def _lesson():
    return (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("lesson")


def _lessons(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(_lesson(), F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("at"))
    return g.agg(F.concat(F.lit("Part "), F.min("l_partkey").cast("string")).alias("title"), F.bool_and(F.col("l_returnflag") != "N").alias("completed"), F.bool_or(F.col("l_linestatus") == "F").alias("ready"))


def _blocks(spark, sf):
    kind = F.when(F.col("l_returnflag") == "R", "definition").when(F.col("l_returnflag") == "A", "example").otherwise("table")
    who = F.element_at(F.array(*map(F.lit, ("early", "late", "local", "large"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    said = F.concat(F.lit("The <b>"), who, F.lit("</b> supplier sends every part of this size"), F.when(F.col("l_suppkey") % 3 == 0, ".").otherwise(" to our yard before noon on any last day."))
    block = F.concat_ws("-", *[F.col(c).cast("bigint").cast("string") for c in ("l_partkey", "l_suppkey", "l_quantity")])
    return table(spark, sf, "lineitem").select(_lesson(), block.alias("block"), F.col("l_quantity").cast("bigint").alias("at"), kind.alias("kind"), said.alias("content"))


def _quizzes(spark, sf):
    g = table(spark, sf, "lineitem").where("l_orderkey % 4 <> 3").groupBy(F.col("l_orderkey").alias("chapter")).agg(F.array_sort(F.collect_set("l_partkey")).alias("q"))
    return g.select("chapter", (F.col("chapter") * 10).alias("quiz"), F.lit(P.PASS_SCORE).alias("pass_score"), F.concat(F.array(F.lit(-1).cast("bigint")), "q").alias("questions"))


def _checks(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("check"), F.col("p_name").alias("prompt"), "p_size")


PLAYER = f"""
ch AS (SELECT o_custkey AS course, o_orderkey AS chapter, o_orderdate AS pos, 'Orders ' || substr(o_orderpriority, 3, 40) AS title, o_orderkey % 9 = 0 AS opened, o_orderstatus <> 'P' AS ready FROM orders),
cc AS (SELECT DISTINCT l_orderkey AS chapter, l_suppkey % 13 AS concept FROM lineitem),
ma AS (SELECT o_custkey AS course, l_suppkey % 13 AS concept, (2 * sum(CAST(round(l_quantity * 1000000) AS BIGINT)) + 50 * count(*)) // (100 * count(*)) AS m FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey % 13 <> 3 GROUP BY ALL),
mm AS (SELECT chapter, (2 * sum(coalesce(m, 0)) + count(*)) // (2 * count(*)) AS m FROM cc JOIN ch USING (chapter) LEFT JOIN ma USING (course, concept) GROUP BY chapter),
bs AS (SELECT event_id - event_id % 2 AS chapter, count(*) AS n_attempts, max(least(1.0, value / 100)) AS best FROM events GROUP BY ALL),
s0 AS (SELECT ch.*, coalesce(n_attempts, 0) AS n_attempts, coalesce(best, 0.0) AS best_score, coalesce(m, 0) AS m FROM ch LEFT JOIN bs USING (chapter) LEFT JOIN mm USING (chapter)),
s1 AS (SELECT *, coalesce(lag(best_score >= {P.PASS_SCORE}) OVER (PARTITION BY course ORDER BY pos, title, chapter), true) AS previous FROM s0),
s AS (SELECT course, chapter, n_attempts, best_score, CASE WHEN best_score >= {P.PASS_SCORE} THEN 'completed' WHEN previous OR opened THEN 'available' ELSE 'locked' END AS state,
  greatest(m, (2 * CAST(round(best_score * 1000000) AS BIGINT) * (CASE WHEN best_score >= {P.PASS_SCORE} THEN 10 ELSE {P.UNPASSED_TENTHS} END) + 10) // 20) / 1000000 AS progress FROM s1),
le AS (SELECT l_orderkey * 100 + l_linenumber AS lesson, l_orderkey AS chapter, l_linenumber AS pos, 'Part ' || min(l_partkey) AS title, bool_and(l_returnflag <> 'N') AS completed, bool_or(l_linestatus = 'F') AS ready FROM lineitem GROUP BY ALL),
bl AS (SELECT l_orderkey * 100 + l_linenumber AS lesson, l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) AS block, CAST(l_quantity AS BIGINT) AS pos,
  CASE l_returnflag WHEN 'R' THEN 'definition' WHEN 'A' THEN 'example' ELSE 'table' END AS kind,
  'The <b>' || ['early', 'late', 'local', 'large'][l_partkey % 4 + 1] || '</b> supplier sends every part of this size' || CASE WHEN l_suppkey % 3 = 0 THEN '.' ELSE ' to our yard before noon on any last day.' END AS content FROM lineitem),
qz AS (SELECT l_orderkey AS chapter, list_concat([-1], list_sort(list(DISTINCT l_partkey))) AS questions FROM lineitem WHERE l_orderkey % 4 <> 3 GROUP BY ALL)"""


@query(f"""WITH {PLAYER}, lb AS (SELECT lesson, string_agg(kind || ':' || block, ',' ORDER BY pos, block) AS b FROM bl GROUP BY lesson),
ph AS (SELECT l_orderkey * 100 + l_linenumber AS lesson, count(DISTINCT l_partkey) FILTER (l_tax > 0.04) AS n FROM lineitem GROUP BY ALL),
ll AS (SELECT chapter, string_agg(title || '[' || n || ']' || b, ';' ORDER BY n, pos, lesson) AS outline, count(*) AS n_lessons FROM le JOIN lb USING (lesson) JOIN ph USING (lesson) GROUP BY chapter),
qq AS (SELECT chapter, string_agg(p_partkey || ':' || p_name, ',' ORDER BY p_partkey) AS asked FROM (SELECT chapter, unnest(questions) AS p_partkey FROM qz) JOIN part USING (p_partkey) GROUP BY chapter)
SELECT s.*, coalesce(n_lessons, 0) AS n_lessons, coalesce(outline, '') AS outline, CASE WHEN q.chapter IS NOT NULL THEN coalesce(asked, '') END AS questions
FROM s LEFT JOIN ll USING (chapter) LEFT JOIN qz q ON q.chapter = s.chapter LEFT JOIN qq ON qq.chapter = s.chapter""")
def course_player(spark, sf):
    states = P.chapter_states(_chapters(spark, sf).drop("ready"), _attempts(spark, sf), _mastery(spark, sf))
    hints = table(spark, sf, "lineitem").groupBy(_lesson()).agg(F.array_sort(F.collect_set(F.when(F.col("l_tax") > 0.04, F.col("l_partkey")))).alias("prerequisites"))
    p = P.course_player(states, _lessons(spark, sf), _blocks(spark, sf), _quizzes(spark, sf), _checks(spark, sf), hints)
    block = lambda b: F.concat(b["kind"], F.lit(":"), b["block"])
    lesson = lambda l: F.concat(l["title"], F.lit("["), F.size(l["prerequisites"]).cast("string"), F.lit("]"), F.array_join(F.transform(l["blocks"], block), ","))  # noqa: E731, E741
    asked = F.array_join(F.transform("quiz.questions", lambda q: F.concat(q["check"].cast("string"), F.lit(":"), q["prompt"])), ",")
    return p.select(
        "course", "chapter", "n_attempts", "best_score", "state", "progress", F.size("lessons").cast("bigint").alias("n_lessons"),
        F.array_join(F.transform("lessons", lesson), ";").alias("outline"), asked.alias("questions"),
    )


ACCESS = f"""{PLAYER}, pq AS (SELECT qz.chapter, coalesce(best, 0) >= {P.PASS_SCORE} AS passed FROM qz LEFT JOIN bs USING (chapter)),
a0 AS (SELECT ch.course, ch.chapter, ch.pos, ch.title, ready, passed, coalesce(passed, false) AS complete FROM ch LEFT JOIN pq USING (chapter)),
a1 AS (SELECT *, ready AND coalesce(lag(complete) OVER (PARTITION BY course ORDER BY pos, title, chapter), true) AS advance FROM a0),
al AS (SELECT le.*, course, advance, coalesce(bool_and(completed) OVER (PARTITION BY chapter ORDER BY le.pos, lesson ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS earlier FROM le JOIN (SELECT chapter, course, advance FROM a1) USING (chapter)),
ac AS (SELECT chapter, bool_or(completed) AS some_done, bool_and(completed) AS all_done FROM le GROUP BY chapter)"""


@query(f"""WITH {ACCESS} SELECT chapter, complete, NOT (ready AND (advance OR coalesce(some_done, false) OR complete)) AS locked,
CASE WHEN passed IS NOT NULL THEN NOT (complete OR advance AND coalesce(all_done, true)) END AS quiz_locked FROM a1 LEFT JOIN ac USING (chapter)""")
def chapter_access(spark, sf):
    return _access(spark, sf)[0].select("chapter", "complete", "locked", "quiz_locked")


@query(f"WITH {ACCESS} SELECT chapter, lesson, completed, NOT (ready AND (completed OR advance AND earlier)) AS locked FROM al")
def lesson_access(spark, sf):
    return _access(spark, sf)[1]


def _access(spark, sf):
    best = _attempts(spark, sf).groupBy("chapter").agg(F.max("score").alias("best"))
    passed = _quizzes(spark, sf).join(best, "chapter", "left").select("chapter", (F.coalesce("best", F.lit(0.0)) >= P.PASS_SCORE).alias("passed"))
    return P.access(_chapters(spark, sf).select("course", "chapter", "at", "title", "ready"), _lessons(spark, sf), passed)


@query(f"""WITH {PLAYER}, q AS (SELECT chapter, len(questions) AS total, unnest(questions) AS p_partkey FROM qz),
an AS (SELECT l_orderkey AS chapter, l_partkey AS p_partkey, l_suppkey % 3 AS attempt, max(l_quantity) AS answer FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
g AS (SELECT chapter * 3 + attempt AS attempt, chapter, total, count(*) AS n_answered, count(*) FILTER (answer > p_size) AS n_correct FROM an JOIN q USING (chapter, p_partkey) JOIN part USING (p_partkey) GROUP BY ALL)
SELECT attempt, chapter, n_answered, n_correct, (2 * n_correct * 1000000 + total) // (2 * total) / 1000000 AS score, (2 * n_correct * 1000000 + total) // (2 * total) / 1000000 >= {P.PASS_SCORE} AS passed FROM g""")
def chapter_quiz_attempts(spark, sf):
    g = table(spark, sf, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("chapter"), F.col("l_partkey").alias("check"), (F.col("l_suppkey") % 3).alias("attempt"))
    answers = g.agg(F.max("l_quantity").alias("answer")).withColumn("attempt", F.col("chapter") * 3 + F.col("attempt"))
    return P.quiz_attempts(_quizzes(spark, sf), answers, _checks(spark, sf), F.col("answer") > F.col("p_size"))


@query("""WITH q AS (SELECT l_orderkey AS attempt, l_linenumber AS pos, min(l_partkey) AS k, max(l_quantity) AS answer, max(l_returnflag) = 'R' AS given FROM lineitem GROUP BY ALL)
SELECT attempt, count(*) AS total, count(*) FILTER (given AND p_size % 5 <> 0) AS n_resolved, count(*) FILTER (given AND p_size % 5 <> 0 AND answer > p_size) AS score FROM q JOIN part ON p_partkey = k GROUP BY ALL""")
def adhoc_quiz_attempts(spark, sf):
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")  # noqa: E741
    g = l.groupBy(F.col("l_orderkey").alias("attempt"), F.col("l_linenumber").alias("at")).agg(F.min("l_partkey").alias("p_partkey"), F.max("l_quantity").alias("answer"), (F.max("l_returnflag") == "R").alias("given"))
    questions = g.join(p, "p_partkey").select("attempt", "at", F.col("p_size").cast("string").alias("label"), "p_size")
    concepts = p.where("p_size % 5 <> 0").select(F.col("p_size").cast("string").alias("label"), F.col("p_size").alias("concept"))
    return P.adhoc_attempt(questions, g.where("given").select("attempt", "at", "answer"), concepts, F.col("answer") > F.col("p_size"))


_KEY = "trim(regexp_replace(lower(regexp_replace(content, '<[^>]+>', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_PROSE = ", ".join(f"'{k}'" for k in P.PROSE)
_SPLIT = "string_split({}.norm, ' ')"
_SAME = f"""length(x[1].norm) <= length(o.norm) * {P.LONGER} AND (contains(o.norm, x[1].norm) OR least(len({_SPLIT.format('x[1]')}), len({_SPLIT.format('o')})) >= {P.LEAST_WORDS}
  AND len(list_intersect({_SPLIT.format('x[1]')}, {_SPLIT.format('o')})) >= {P.COMMON} * len(list_distinct({_SPLIT.format('x[1]')})))"""


@query(f"""WITH {PLAYER}, b AS (SELECT lesson // 100 AS lesson, block, pos, kind, {_KEY} AS norm FROM bl),
one AS (SELECT lesson, kind, norm, min(struct_pack(at := pos, block := block)) AS r FROM b GROUP BY ALL),
ls AS (SELECT lesson, list([struct_pack(at := r.at, block := r.block, norm := norm)] ORDER BY r.at, r.block) AS rows FROM one WHERE kind IN ({_PROSE}) GROUP BY lesson),
kp AS (SELECT lesson, unnest(list_reduce(rows, lambda acc, x: CASE WHEN len(list_filter(acc, lambda o: {_SAME})) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM ls),
al AS (SELECT lesson, k.block AS block FROM kp UNION ALL SELECT lesson, r.block FROM one WHERE kind NOT IN ({_PROSE}))
SELECT lesson, block, kind FROM b WHERE (lesson, block) IN (SELECT (lesson, block) FROM al)""")
def distinct_lesson_blocks(spark, sf):
    b = _blocks(spark, sf).withColumn("lesson", F.floor(F.col("lesson") / 100))
    return P.distinct_blocks(b, concept_key(F.regexp_replace("content", "<[^>]+>", " "))).select("lesson", "block", "kind")
