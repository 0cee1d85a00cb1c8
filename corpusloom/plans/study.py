"""The operators for course material bound to the driver's tables, with DuckDB SQL for the same results."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import documents as D
from corpusloom.operators import learning as L
from corpusloom.operators import retrieval as R
from corpusloom.operators import study as S
from corpusloom.plans.registry import (
    BM25, EDGES, OVERLAP, QUERIES, TOKENS, _asked, _bm25, _bm25_top, _docs, _edges, _overlap_top, _questions, _seeds, _vectors, query, table,
)


@query("""WITH g AS (SELECT source, count(*) AS n, max(struct_pack(s := n_chars, l := length(text), b := -doc_id)) AS m FROM documents GROUP BY ALL)
SELECT source, n, -m.b AS doc_id, CAST(row_number() OVER (ORDER BY n DESC, source) AS INT) AS pos FROM g""")
def topic_buckets(spark, sf):
    return S.topic_buckets(_docs(spark, sf).withColumn("score", F.col("n_chars")), "source")


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i,
  row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS j, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k,
  least(2, greatest(1, count(*) OVER (PARTITION BY source) // 10)) AS most FROM documents),
p AS (SELECT source, doc_id, i AS first_at FROM r WHERE i <= most UNION ALL SELECT source, doc_id, 100 + k FROM r WHERE k <= 6
  UNION ALL SELECT source, doc_id, 300 - j FROM r WHERE j <= most),
f AS (SELECT source, doc_id, min(first_at) AS first_at FROM p GROUP BY ALL)
SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY first_at, doc_id) AS INT) AS pos FROM f""")
def narrative_arc(spark, sf):
    docs = _docs(spark, sf)
    middle = R.top_k(docs.select("source", "doc_id", F.col("n_chars").alias("score")), 6, per="source")
    return S.narrative_arc(docs, middle, "source")


@query(f"""WITH {BM25}, pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM bm QUALIFY r <= 30),
z AS (SELECT query_id, doc_id, round((len(regexp_extract_all(array_to_string(list_transform(string_split_regex(
    regexp_replace(text, '[^\\p{{L}}\\p{{N}}_ \\t\\n\\r\\f]+', ' | ', 'g'), '[ \\t\\n\\r\\f]+'), lambda w: CASE WHEN regexp_matches(w, '^[A-Z][a-z]+$') THEN 'C' ELSE 'x' END), ''), 'CC+'))
  + len(list_filter({TOKENS}, lambda w: regexp_matches(w, '.(ed|ing|es)$'))))::DOUBLE / len({TOKENS}), 6) AS score FROM pool JOIN documents USING (doc_id) WHERE len({TOKENS}) > 0)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM z QUALIFY rank <= 10""")
def relationship_dense(spark, sf):
    pool = R.top_k(_bm25(spark, sf), 30).select("query_id", "doc_id")
    texts = _docs(spark, sf).select("doc_id", S.relationship_density(F.col("text")).alias("score")).where("score IS NOT NULL")
    return R.top_k(pool.join(texts, "doc_id").select("query_id", "doc_id", "score"), 10)


@query(f"""WITH w AS (SELECT conv_id, turn, list_distinct({TOKENS}) AS t FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.t AS x, b.t AS y, len(list_intersect(a.t, b.t)) AS n FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE ELSE round(n::DOUBLE / (len(x) + len(y) - n), 6) END AS score FROM p""")
def jaccard_pairs(spark, sf):
    c = table(spark, sf, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", S.jaccard(F.col("text"), F.col("after")).alias("score"))


@query(f"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark),
n AS (SELECT conv_id * 1000 + turn AS node_id, CASE WHEN role = 'assistant' THEN 'concept' ELSE 'document' END AS type, {TOKENS} AS w FROM conversations),
s AS (SELECT query_id, node_id, type, sum(CASE WHEN list_contains(w, term) THEN 3 ELSE 0 END
  + CASE WHEN length(term) >= 5 AND len(list_filter(w, lambda x: contains(x, term))) > 0 THEN 1 ELSE 0 END) AS hits FROM q, n GROUP BY ALL)
SELECT query_id, node_id, CAST(hits AS DOUBLE) + CASE WHEN type = 'concept' THEN 0.5 ELSE 0 END AS score FROM s WHERE hits > 0""")
def node_scoring(spark, sf):
    kind = F.when(F.col("role") == "assistant", "concept").otherwise("document")
    nodes = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node_id"), kind.alias("type"), "text")
    terms = _questions(spark, sf).select("query_id", F.explode(S.tokens(F.col("text"))).alias("term"))
    return S.node_scores(nodes, terms)


STATEMENTS = """
c0 AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(list_transform(
  string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM documents)),
c1 AS (SELECT doc_id, pos, regexp_replace(trim(regexp_replace(s, '\\s+', ' ', 'g'), ' -*#:;'), '^\\d+(\\.\\d+)*\\s+', '') AS s FROM c0),
c2 AS (SELECT doc_id, pos, CASE WHEN length(s) > 180 THEN rtrim(regexp_replace(substr(s, 1, 177), ' [^ ]*$', ''), ',;:') ELSE s END AS s
  FROM c1 WHERE length(s) >= 24 AND NOT ends_with(s, '?')),
c3 AS (SELECT doc_id, pos, CASE WHEN regexp_matches(s, '[.!]$') THEN s ELSE s || '.' END AS s FROM c2),
st AS (SELECT doc_id, CAST(pos AS INT) AS pos, s AS statement FROM c3 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(s) ORDER BY pos) = 1)"""


@query(f"WITH {STATEMENTS} SELECT doc_id, pos, md5(statement) AS digest FROM st")
def statement_candidates(spark, sf):
    return S.statements(_docs(spark, sf)).select("doc_id", "pos", F.md5("statement").alias("digest"))


@query(f"""WITH {STATEMENTS},
w AS (SELECT doc_id, unnest({TOKENS}) AS term, generate_subscripts({TOKENS}, 1) AS first_at FROM documents),
k AS (SELECT doc_id, term, count(*) AS n, min(first_at) AS first_at FROM w WHERE length(term) >= 5 GROUP BY ALL),
k8 AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) <= 8),
h AS (SELECT doc_id, pos, count(*) FILTER (contains(lower(statement), term)) AS hits FROM st JOIN k8 USING (doc_id) GROUP BY ALL)
SELECT doc_id, pos, CAST(hits AS INT) AS hits FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, pos) = 1""")
def best_statement(spark, sf):
    docs = _docs(spark, sf)
    return S.best_statements(S.statements(docs), D.key_terms(docs).groupBy("doc_id").agg(F.collect_list("term").alias("terms")))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM embeddings, q WHERE vec_id <> query_id),
b AS (SELECT *, true AS i FROM s WHERE score BETWEEN 0.4 AND 0.7 UNION ALL SELECT *, false FROM s WHERE score < 0.999),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, i ORDER BY score DESC, doc_id) AS INT) AS rank FROM b QUALIFY rank <= 3)
SELECT query_id, doc_id, score, rank FROM (SELECT *, count(*) FILTER (i) OVER (PARTITION BY query_id) >= 3 AS f FROM r) WHERE i = f""")
def distractor_band(spark, sf):
    return S.distractors(_vectors(spark, sf), _asked(spark, sf))


@query("""WITH a AS (SELECT o_orderkey, ['mcq', 'true_false', 'fill_blank'][o_orderkey % 3 + 1] AS kind, o_orderkey % 5 AS x, o_custkey % 5 AS y, o_orderstatus AS s, o_totalprice > 150000 AS t, o_orderpriority AS p FROM orders)
SELECT o_orderkey, kind, CAST(CASE kind WHEN 'mcq' THEN x = y WHEN 'true_false' THEN CASE s WHEN 'O' THEN t WHEN 'F' THEN NOT t ELSE false END
  ELSE trim(regexp_replace(lower(p), '[^\\p{L}\\p{N}]+', ' ', 'g')) = '1 urgent' END AS DOUBLE) AS score FROM a""")
def grade_answers(spark, sf):
    key = F.col("o_orderkey")
    kind = F.when(key % 3 == 0, "mcq").when(key % 3 == 1, "true_false").otherwise("fill_blank")
    said = F.when(F.col("o_orderstatus") == "O", " Yes").when(F.col("o_orderstatus") == "F", "f").otherwise("maybe")
    answer = F.when(key % 3 == 0, (key % 5).cast("string")).when(key % 3 == 1, said).otherwise(F.col("o_orderpriority"))
    expected = (
        F.when(key % 3 == 0, (F.col("o_custkey") % 5).cast("string")).when(key % 3 == 1, (F.col("o_totalprice") > 150000).cast("string"))
        .otherwise("1: Urgent")
    )
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), S.grade(kind, answer, expected).alias("score"))


@query(f"""WITH w AS (SELECT conv_id, turn, role, list_distinct({TOKENS}) AS t FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.t AS said, list_filter(b.t, lambda x: length(x) > 2) AS e FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant')
SELECT conv_id, turn, CASE WHEN len(e) = 0 THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, len(list_intersect(said, e))::DOUBLE / len(e) + CASE WHEN len(said) >= 8 THEN 0.2::DOUBLE ELSE 0 END), 6) END AS score FROM p""")
def short_answer_score(spark, sf):
    c = table(spark, sf, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("expected"))
    rows = c.where("role = 'assistant'").join(before, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", S.short_answer_score(F.col("text"), F.col("expected")).alias("score"))


@query(f"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, length(t) >= 4 AND t NOT IN {S.GREETINGS} AND (contains(t, '?') OR {' OR '.join(f"starts_with(t, '{s}')" for s in S.STARTERS)}) AS asks FROM t""")
def learning_question_filter(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.is_learning_question(F.col("text")).alias("asks"))


def _has(phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join("contains(t, '" + p.replace("'", "''") + "')" for p in phrases) + ")"


@query(f"""WITH m AS (SELECT conv_id, turn, lower(trim(text, ' ')) AS t, turn > min(turn) OVER (PARTITION BY conv_id) AS h FROM conversations),
i AS (SELECT *, CASE WHEN {_has(S.CONFUSED)} THEN 'confusion' WHEN h AND {_has(S.CLARIFY)} THEN 'clarification' WHEN {_has(S.CONFIRM)} THEN 'confirmation'
  WHEN h AND len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) < 12 THEN 'follow_up' ELSE 'new_question' END AS intent FROM m)
SELECT conv_id, turn, intent, CASE intent WHEN 'confusion' THEN 0.85::DOUBLE WHEN 'clarification' THEN 0.45::DOUBLE WHEN 'confirmation' THEN 0.25::DOUBLE WHEN 'follow_up' THEN 0.2::DOUBLE ELSE 0.15::DOUBLE END AS confusion,
  CASE WHEN intent = 'confusion' THEN CASE WHEN turn > 3 THEN 'explain' ELSE 'guide' END WHEN intent = 'confirmation' THEN 'quiz_back' ELSE 'explain' END AS mode FROM i""")
def intent_and_mode(spark, sf):
    first = F.min("turn").over(Window.partitionBy("conv_id"))
    m = table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", (F.col("turn") > first).alias("has_history"), F.col("turn").alias("turns_since_progress")
    )
    return S.reply_mode(m).select("conv_id", "turn", "intent", "confusion", "mode")


@query(f"""WITH w AS (SELECT doc_id, source, unnest({TOKENS}) AS term, generate_subscripts({TOKENS}, 1) AS first_at FROM documents),
k AS (SELECT doc_id, source, term, count(*) AS n, min(first_at) AS first_at FROM w WHERE length(term) >= 5 GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) AS INT) AS pos, 'What does ' || source || ' explain about ' || term || '?' AS question FROM k QUALIFY pos <= 3""")
def generated_questions(spark, sf):
    docs = _docs(spark, sf)
    return S.chunk_questions(D.key_terms(docs, 3).join(docs.select("doc_id", "source"), "doc_id"), "source")


@query("""WITH c AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey, (i - 1) * least(5, (n + 7) // 8) // n AS phase FROM c""")
def learning_map_phases(spark, sf):
    return S.learning_phases(table(spark, sf, "part"), "p_brand", "p_partkey")


@query("""WITH m AS (SELECT user_id AS learner, event_id % 7 AS chapter, avg(value / 100) AS mean, max(value / 100) FILTER (event_type = 'purchase') AS best FROM events GROUP BY ALL)
SELECT learner, chapter, round(greatest(mean, CASE WHEN coalesce(best, 0) >= 0.7 THEN best ELSE 0.7::DOUBLE * coalesce(best, 0) END), 6) AS progress FROM m""")
def chapter_progress(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("learner"), (F.col("event_id") % 7).alias("chapter"), "event_type", (F.col("value") / 100).alias("mastery")
    )
    best = e.where("event_type = 'purchase'").groupBy("learner", "chapter").agg(F.max("mastery").alias("best"))
    return S.chapter_progress(e, best)


@query(f"""WITH {EDGES}, r AS (SELECT DISTINCT source, target FROM e WHERE relation = 'requires'),
d1 AS (SELECT source AS seed, target AS node, 1 AS depth FROM r WHERE source % 20 = 0),
d2 AS (SELECT DISTINCT d1.seed, r.target AS node, 2 AS depth FROM d1 JOIN r ON r.source = d1.node),
d AS (SELECT seed, node, CAST(min(depth) AS INT) AS depth FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2) WHERE seed <> node GROUP BY ALL),
m AS (SELECT event_id AS node, avg(value) / 100 AS mastery FROM events GROUP BY ALL)
SELECT seed, node, depth, CAST(row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS INT) AS rank FROM d LEFT JOIN m USING (node) WHERE coalesce(mastery, 0) < 0.7 QUALIFY rank <= 4""")
def remediation(spark, sf):
    mastery = table(spark, sf, "events").groupBy(F.col("event_id").alias("node")).agg((F.avg("value") / 100).alias("mastery"))
    return S.remediation(L.prerequisites(_edges(spark, sf), _seeds(spark, sf), 2), mastery)


@query("""SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'part_of' AS relation FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'part_of' FROM customer
UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'supports' FROM orders
UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'teaches' FROM lineitem""")
def graph_edges_build(spark, sf):
    def edges(name: str, a: str, x: str, b: str, y: str, relation: str):
        node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
        return table(spark, sf, name).select(node(a, x).alias("source"), node(b, y).alias("target"), F.lit(relation).alias("relation"))

    return reduce(lambda a, b: a.unionByName(b), [
        edges("nation", "nation", "n_nationkey", "region", "n_regionkey", "part_of"),
        edges("customer", "customer", "c_custkey", "nation", "c_nationkey", "part_of"),
        edges("orders", "order", "o_orderkey", "customer", "o_custkey", "supports"),
        edges("lineitem", "order", "l_orderkey", "part", "l_partkey", "teaches").distinct(),
    ])


@query("""SELECT source, count(*) AS total, count(l.doc_id) AS ready, count(*) - count(l.doc_id) AS stale, count(*) = count(l.doc_id) AS all_ready
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source""")
def stale_index_status(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("has"))
    rows = _docs(spark, sf).select("doc_id", "source").join(labels, "doc_id", "left")
    n, ready = F.count(F.lit(1)), F.count("has")
    return rows.groupBy("source").agg(n.alias("total"), ready.alias("ready"), (n - ready).alias("stale"), (n == ready).alias("all_ready"))


@query("""SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS pending, bool_and(o_orderstatus <> 'O') AS ready FROM orders GROUP BY ALL""")
def file_ready_barrier(spark, sf):
    open_ = F.col("o_orderstatus") == "O"
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(open_).alias("pending"), F.bool_and(~open_).alias("ready")
    )


@query("""WITH a AS (SELECT user_id, event_id % 7 AS chapter, event_id // 50 AS attempt, avg(CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM events GROUP BY ALL)
SELECT user_id, chapter, count(*) AS n_attempts, round(max(score), 6) AS best, max(score) >= 0.7 AS passed FROM a GROUP BY ALL""")
def best_score(spark, sf):
    right = F.when(F.col("value") >= 50, 1.0).otherwise(0.0)
    attempts = table(spark, sf, "events").groupBy("user_id", (F.col("event_id") % 7).alias("chapter"), F.floor(F.col("event_id") / 50).alias("attempt"))
    best = F.max("score")
    return attempts.agg(F.avg(right).alias("score")).groupBy("user_id", "chapter").agg(
        F.count(F.lit(1)).alias("n_attempts"), F.round(best, 6).alias("best"), (best >= 0.7).alias("passed")
    )


@query(f"""WITH {BM25}, {OVERLAP}, gold AS (SELECT query_id, doc_id FROM orr WHERE rank <= 3),
v AS (SELECT 'bm25' AS variant, query_id, doc_id FROM bmr WHERE rank <= 5 UNION ALL SELECT 'overlap', query_id, doc_id FROM orr WHERE rank <= 5),
h AS (SELECT variant, query_id, count(gold.doc_id)::DOUBLE / 3 AS recall FROM v LEFT JOIN gold USING (query_id, doc_id) GROUP BY ALL)
SELECT variant, count(*) AS n_cases, round(avg(recall), 4) AS recall_5 FROM h GROUP BY ALL""")
def variant_comparison(spark, sf):
    bm, over = _bm25_top(spark, sf), _overlap_top(spark, sf)
    gold = over.where("rank <= 3").select("query_id", "doc_id", F.lit(1).alias("hit"))
    both = bm.where("rank <= 5").select(F.lit("bm25").alias("variant"), "query_id", "doc_id").unionByName(
        over.where("rank <= 5").select(F.lit("overlap").alias("variant"), "query_id", "doc_id")
    )
    per = both.join(gold, ["query_id", "doc_id"], "left").groupBy("variant", "query_id").agg((F.count("hit") / 3).alias("recall"))
    return per.groupBy("variant").agg(F.count(F.lit(1)).alias("n_cases"), F.round(F.avg("recall"), 4).alias("recall_5"))


@query()
def topic_clusters(spark, sf):
    """The vector nearest to the centre of each of ten k-means clusters (seed 0, 20 rounds)."""
    v = _vectors(spark, sf).select("doc_id", F.col("embedding").cast("array<double>").alias("e"))
    v = v.withColumn("features", array_to_vector("e"))
    model = KMeans(k=10, seed=0, maxIter=20).fit(v)
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, c array<double>")
    apart = F.aggregate(F.zip_with("e", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    placed = model.transform(v).join(F.broadcast(centres), "prediction")
    best = F.min(F.struct(F.round(apart, 9).alias("apart"), "doc_id"))
    return placed.groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), best["doc_id"].alias("doc_id"))


__all__ = ["QUERIES"]
