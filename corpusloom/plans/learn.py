"""Learner progress, quizzes and review windows on the driver's tables, with DuckDB SQL for the same results.

Nations stand for concepts, thirds of them for objectives; events are a learner's encounters.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions.text import concept_key
from corpusloom.operators import progress as P
from corpusloom.plans.registry import query, table

STATE = """st AS (SELECT user_id AS learner, event_id % 25 AS concept, (2 * sum(CAST(round(value * 1000000) AS BIGINT)) + 100 * count(*)) // (200 * count(*)) / 1000000 AS mastery, count(*) AS encounters,
  count(*) FILTER (value < 25) AS struggles FROM events GROUP BY ALL),
ob AS (SELECT n_nationkey // 3 AS objective, (n_nationkey // 3) % 4 AS phase, n_nationkey AS concept FROM nation),
os AS (SELECT objective, phase, count(*) AS n FROM ob GROUP BY ALL),
op AS (SELECT learner, objective, phase, (2 * sum(CAST(round(mastery * 1000000) AS BIGINT)) + n) // (2 * n) / 1000000 AS mastery, CAST(sum(encounters) AS BIGINT) AS encounters, CAST(sum(struggles) AS BIGINT) AS struggles
  FROM st JOIN ob USING (concept) JOIN os USING (objective, phase) GROUP BY learner, objective, phase, n)"""


def _state(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("learner"), (F.col("event_id") % 25).alias("concept")).agg(
        F.sum(P.millionths(F.col("value"))).alias("total"), F.count(F.lit(1)).alias("encounters"), F.count_if(F.col("value") < 25).alias("struggles")
    ).select("learner", "concept", P.mean(F.col("total"), F.col("encounters"), 100).alias("mastery"), "encounters", "struggles")


def _objectives(spark, sf):
    third = F.floor(F.col("n_nationkey") / 3)
    return table(spark, sf, "nation").select(third.alias("objective"), (third % 4).alias("phase"), F.col("n_nationkey").cast("bigint").alias("concept"))


@query(f"WITH {STATE} SELECT * FROM op")
def objective_rollup(spark, sf):
    return P.objective_progress(_state(spark, sf), _objectives(spark, sf))


PHASES = """pt AS (SELECT phase, count(DISTINCT objective) AS total FROM ob GROUP BY ALL),
pp AS (SELECT learner, phase, (2 * sum(CAST(round(mastery * 1000000) AS BIGINT)) + total) // (2 * total) / 1000000 AS mastery, total, count(*) FILTER (mastery >= 0.7) AS mastered, CAST(sum(struggles) AS BIGINT) AS struggles
  FROM op JOIN pt USING (phase) GROUP BY learner, phase, total)"""


@query(f"WITH {STATE}, {PHASES} SELECT * FROM pp")
def phase_rollup(spark, sf):
    o = _objectives(spark, sf)
    return P.phase_progress(P.objective_progress(_state(spark, sf), o), o)


@query(f"""WITH {STATE}, {PHASES} SELECT learner, 'concept' AS level, concept AS id, mastery FROM st UNION ALL SELECT learner, 'objective', objective, mastery FROM op
UNION ALL SELECT learner, 'phase', phase, mastery FROM pp""")
def progress_snapshot(spark, sf):
    s, o = _state(spark, sf), _objectives(spark, sf)
    by = P.objective_progress(s, o)
    level = lambda d, name, c: d.select("learner", F.lit(name).alias("level"), F.col(c).alias("id"), "mastery")
    return level(s, "concept", "concept").unionByName(level(by, "objective", "objective")).unionByName(level(P.phase_progress(by, o), "phase", "phase"))


@query(f"""WITH {STATE}, r AS (SELECT learner, objective, row_number() OVER (PARTITION BY learner ORDER BY mastery, encounters, objective) AS r FROM op),
f AS (SELECT learner, concept, min(r) AS r FROM r JOIN ob USING (objective) WHERE r <= 5 GROUP BY ALL)
SELECT learner, concept, CAST(row_number() OVER (PARTITION BY learner ORDER BY r, concept) AS INT) AS pos FROM f QUALIFY pos <= 5""")
def weakest_objective_concepts(spark, sf):
    o = _objectives(spark, sf)
    return P.concepts_of_weakest(P.objective_progress(_state(spark, sf), o), o, 5)


@query(f"""WITH {STATE} SELECT learner, concept, CAST(row_number() OVER (PARTITION BY learner ORDER BY mastery, encounters, -n_regionkey, lower(n_name)) AS INT) AS rank
FROM st JOIN nation ON n_nationkey = concept QUALIFY rank <= 4""")
def weakest_by_importance(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("concept"), "n_name", "n_regionkey")
    order = Window.partitionBy("learner").orderBy("mastery", "encounters", -F.col("n_regionkey"), F.lower("n_name"))
    ranked = _state(spark, sf).join(n, "concept").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= 4).select("learner", "concept", "rank")


def _ops(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("learner"), (F.col("event_id") % 25).alias("concept"), F.col("event_id").alias("seq"),
        F.when(v >= 80, "demonstrated").when(v < 20, "struggled").otherwise("covered").alias("op"),
    )


@query("""WITH e AS (SELECT user_id AS learner, event_id % 25 AS concept, event_id AS seq, CASE WHEN value >= 80 THEN 'd' WHEN value < 20 THEN 's' ELSE 'c' END AS op FROM events),
f AS (SELECT learner, concept, list_reduce(list_prepend(-1.0::DOUBLE, list(CASE op WHEN 'd' THEN 2.0::DOUBLE WHEN 's' THEN -2.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY seq)),
  lambda m, o: CASE WHEN o > 1 THEN greatest(m, 0.75) WHEN o < -1 THEN CASE WHEN m < 0 THEN 0.35 ELSE least(m, 0.35) END ELSE CASE WHEN m < 0 THEN 0.15 ELSE m END END) AS mastery,
  count(*) FILTER (op = 'd') > 0 AS understood, coalesce(max(seq) FILTER (op = 's') > coalesce(max(seq) FILTER (op = 'd'), -1), false) AS struggling FROM e GROUP BY ALL)
SELECT learner, concept, CAST(mastery AS DOUBLE) AS mastery, understood, struggling FROM f""")
def local_learner_state(spark, sf):
    return P.local_state(_ops(spark, sf))


LEGACY = """lg AS (SELECT user_id AS learner, 'Nation ' || (event_id % 30) AS label, max(value / 100) AS score FROM events GROUP BY ALL)"""


def _legacy(spark, sf):
    label = F.concat(F.lit("Nation "), (F.col("event_id") % 30).cast("string"))
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("learner"), label.alias("label")).agg(F.max(F.col("value") / 100).alias("score"))
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("concept"), F.col("n_name").alias("name"))
    return P.migrate_labels(e, names, _state(spark, sf), concept_key)


@query(f"""WITH {STATE}, {LEGACY}, m AS (SELECT learner, CAST(n_nationkey AS BIGINT) AS concept, score AS mastery FROM lg JOIN nation ON replace(lower(n_name), '_', ' ') = lower(label))
SELECT learner, concept, max(mastery) AS mastery FROM (SELECT * FROM m UNION ALL SELECT learner, concept, mastery FROM st) GROUP BY ALL""")
def legacy_progress(spark, sf):
    return _legacy(spark, sf)[0]


@query(f"WITH {LEGACY} SELECT * FROM lg WHERE lower(label) NOT IN (SELECT replace(lower(n_name), '_', ' ') FROM nation)")
def legacy_unmapped(spark, sf):
    return _legacy(spark, sf)[1]


@query("""WITH c AS (SELECT p_partkey, ['remember', 'understand', 'apply', 'analyze'][p_size % 4 + 1] AS bloom, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part)
SELECT p_partkey, bloom, CASE WHEN bloom IN ('apply', 'analyze') THEN 'short_answer' ELSE ['mcq', 'true_false', 'fill_blank', 'short_answer'][i % 4 + 1] END AS type,
  CASE bloom WHEN 'remember' THEN 'understand' WHEN 'understand' THEN 'apply' ELSE 'analyze' END AS stretch FROM c""")
def check_types(spark, sf):
    bloom = F.get(F.array(*map(F.lit, P.BLOOM)), (F.col("p_size") % 4).cast("int"))
    c = table(spark, sf, "part").select("p_partkey", bloom.alias("bloom"), (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("i"))
    return c.select("p_partkey", "bloom", P.check_type(F.col("i"), F.col("bloom")).alias("type"), P.stretch(F.col("bloom")).alias("stretch"))


@query("""SELECT l_orderkey AS quiz, count(*) AS total, count(*) FILTER (l_returnflag <> 'N') AS answered, count(*) FILTER (l_returnflag <> 'N' AND l_returnflag = CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'R' END) AS correct,
  round(count(*) FILTER (l_returnflag <> 'N' AND l_returnflag = CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'R' END)::DOUBLE / count(*), 6) AS score,
  round(count(*) FILTER (l_returnflag <> 'N' AND l_returnflag = CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'R' END)::DOUBLE / count(*), 6) >= 0.7 AS passed
FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def quiz_grading(spark, sf):
    q = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("quiz"), F.col("l_linenumber").alias("question")).agg(F.min("l_returnflag").alias("f"))
    expected = F.when(F.col("question") % 2 == 0, "A").otherwise("R")
    return P.grade_all(q.select("quiz", "question", expected.alias("expected")), q.where("f != 'N'").select("quiz", "question", F.col("f").alias("answer")))


@query("SELECT user_id AS learner, event_id % 7 AS quiz, count(*) AS n_attempts, max(value) AS score FROM events GROUP BY ALL")
def quiz_progress_merge(spark, sf):
    e = table(spark, sf, "events")
    return P.merge_quiz_progress(e.select(F.col("user_id").alias("learner"), (F.col("event_id") % 7).alias("quiz"), F.col("value").alias("score")))


@query("""WITH p AS (SELECT user_id AS learner, event_id % 7 AS chapter, bool_or(value >= 90) AS passed FROM events GROUP BY ALL),
o AS (SELECT DISTINCT user_id AS learner, event_id % 7 AS chapter FROM events WHERE event_type = 'error' AND value < 10)
SELECT learner, chapter, passed, NOT coalesce(b, true) AND o.learner IS NULL AS locked FROM (SELECT *, lag(passed) OVER (PARTITION BY learner ORDER BY chapter) AS b FROM p) LEFT JOIN o USING (learner, chapter)""")
def chapter_locks_with_override(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("learner"), (F.col("event_id") % 7).alias("chapter"), "event_type", "value")
    opened = e.where("event_type = 'error' AND value < 10").select("learner", "chapter")
    return P.locked_after_unpassed(e.withColumn("passed", F.col("value") >= 90), opened)


@query("""WITH r AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS w, count(*) OVER (PARTITION BY user_id) AS answered FROM events),
g AS (SELECT user_id, w, answered, count(*) AS n, (w + 1) * 10 AS due_count, ['pending', 'snoozed', 'dismissed', 'submitted'][w % 4 + 1] AS status FROM r GROUP BY ALL)
SELECT user_id, w AS "window", status, due_count, CASE WHEN status IN ('pending', 'started') THEN true WHEN status = 'snoozed' THEN answered >= due_count + 2 ELSE false END AS due,
  CAST(least(n, CASE WHEN n <= 3 THEN 3 WHEN n >= 7 THEN 7 ELSE 5 END) AS BIGINT) AS n_questions FROM g""")
def review_window_status(spark, sf):
    w = Window.partitionBy("user_id")
    e = table(spark, sf, "events").select("user_id", F.floor((F.row_number().over(w.orderBy("event_id")) - 1) / 10).alias("window"), F.count(F.lit(1)).over(w).alias("answered"))
    g = e.groupBy("user_id", "window", "answered").agg(F.count(F.lit(1)).alias("n")).withColumn("due_count", (F.col("window") + 1) * 10)
    status = F.get(F.array(*map(F.lit, ("pending", "snoozed", "dismissed", "submitted"))), (F.col("window") % 4).cast("int"))
    due = P.window_due(status, F.col("answered"), F.col("due_count") + 2, F.col("due_count"))
    n = P.question_count(F.col("n"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")).cast("bigint")
    return g.select("user_id", "window", status.alias("status"), "due_count", due.alias("due"), n.alias("n_questions"))


@query("""WITH w AS (SELECT doc_id FROM labels WHERE toxic = 1), m AS (SELECT source, doc_id, doc_id IN (SELECT doc_id FROM w) AS i FROM documents)
SELECT source, doc_id FROM (SELECT *, count(*) FILTER (i) OVER (PARTITION BY source) AS n FROM m) WHERE i OR n = 0""")
def window_source_scope(spark, sf):
    return P.scoped_or_all(table(spark, sf, "documents").select("source", "doc_id"), table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "source", "doc_id")


@query("""SELECT source, count(DISTINCT d.doc_id) AS n_total, count(DISTINCT l.doc_id) AS n_covered, round(count(DISTINCT l.doc_id)::DOUBLE / count(DISTINCT d.doc_id), 6) AS ratio
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source""")
def coverage_metadata(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id")
    return P.coverage(d.join(table(spark, sf, "labels").select("doc_id"), "doc_id"), d, "source", "doc_id")


@query("""WITH x AS (SELECT user_id, event_id, unnest([event_id % 5, event_id % 3]) AS c, generate_subscripts([event_id % 5, event_id % 3], 1) AS n FROM events),
c AS (SELECT user_id, c, min(event_id * 10 + n) AS f FROM x GROUP BY ALL), t AS (SELECT user_id, event_type AS k, min(event_id) AS f FROM events GROUP BY ALL)
SELECT user_id, array_to_string(list(c ORDER BY f), ',') AS concepts, (SELECT string_agg(k, ',' ORDER BY t.f) FROM t WHERE t.user_id = c.user_id) AS sources FROM c GROUP BY user_id""")
def ordered_id_unions(spark, sf):
    id_ = F.col("event_id")
    e = table(spark, sf, "events").select("user_id", "event_id", F.array(id_ % 5, id_ % 3).alias("concepts"), F.array("event_type").alias("sources"))
    u = P.ordered_distinct(e, "user_id", "event_id", ["concepts", "sources"])
    return u.select("user_id", F.array_join(F.transform("concepts", lambda x: x.cast("string")), ",").alias("concepts"), F.array_join("sources", ",").alias("sources"))


@query("""WITH a AS (SELECT o_orderkey, o_custkey % 10 / 10.0::DOUBLE AS b, CASE WHEN o_orderpriority LIKE '1%' THEN 0.95::DOUBLE WHEN o_orderpriority LIKE '2%' THEN 0.7::DOUBLE WHEN o_orderpriority LIKE '3%' THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END AS s, o_orderkey % 2 = 0 AS h FROM orders)
SELECT o_orderkey, b AS before, s AS score, round(CASE WHEN s >= 0.85 THEN b + CASE WHEN h THEN 0.25::DOUBLE ELSE 0.16::DOUBLE END * (1 - b) WHEN s >= 0.6 THEN b + 0.1::DOUBLE * (1 - b) WHEN s >= 0.25 THEN b * 0.75::DOUBLE ELSE b * 0.6::DOUBLE END, 9) AS after, s < 0.6 AS remediate FROM a""")
def submitted_checks(spark, sf):
    from corpusloom.operators.learning import assessment_step

    p = F.substring("o_orderpriority", 1, 1)
    score = F.when(p == "1", 0.95).when(p == "2", 0.7).when(p == "3", 0.4).otherwise(0.1)
    a = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 10 / 10.0).alias("before"), score.alias("score"), (F.col("o_orderkey") % 2 == 0).alias("hard"))
    after = F.round(assessment_step(F.col("before"), F.col("score"), F.col("hard")), 9)
    return a.select("o_orderkey", "before", "score", after.alias("after"), (F.col("score") < 0.6).alias("remediate"))


@query("""WITH a AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant'), u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')
SELECT a.conv_id, a.turn, min(md5(u.text)) AS question FROM a LEFT JOIN u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 GROUP BY ALL""")
def answered_question_log(spark, sf):
    c = table(spark, sf, "conversations")
    asked = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.md5("text").alias("q"))
    return c.where("role = 'assistant'").select("conv_id", "turn").dropDuplicates(["conv_id", "turn"]).join(asked, ["conv_id", "turn"], "left").groupBy("conv_id", "turn").agg(F.min("q").alias("question"))


@query("""WITH c AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) - 1 AS i FROM part)
SELECT p_brand, p_partkey, CAST(i AS INT) AS pos, ['mcq', 'true_false', 'short_answer'][i % 3 + 1] AS type FROM c WHERE i < 5""")
def chapter_quiz_questions(spark, sf):
    i = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")) - 1
    c = table(spark, sf, "part").select("p_brand", "p_partkey", i.alias("pos")).where("pos < 5")
    return c.withColumn("type", F.get(F.array(*map(F.lit, ("mcq", "true_false", "short_answer"))), F.col("pos") % 3))


@query("""SELECT l_suppkey AS objective, p.p_partkey AS concept, lag(p.p_partkey) OVER (PARTITION BY l_suppkey ORDER BY p.p_partkey) AS requires FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part p ON p.p_partkey = l_partkey""")
def previous_concept_chain(spark, sf):
    e = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")
    before = F.lag("l_partkey").over(Window.partitionBy("l_suppkey").orderBy("l_partkey"))
    return e.select(F.col("l_suppkey").alias("objective"), F.col("l_partkey").alias("concept"), before.alias("requires"))


@query("""SELECT count(*) AS messages, count(*) FILTER (role = 'user') AS asked, count(DISTINCT conv_id) AS conversations FROM conversations""")
def filtered_counts(spark, sf):
    return table(spark, sf, "conversations").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("asked"), F.countDistinct("conv_id").alias("conversations")
    )
