"""Course building on the driver's tables and course texts, with DuckDB SQL for the same results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions.text import cosine, tokens
from corpusloom.operators import build as B
from corpusloom.operators import outline as O
from corpusloom.plans.concepts import KEY
from corpusloom.plans.course import R, _sections
from corpusloom.plans.registry import TOKENS, _docs, query, table

GRAPH = """gr AS (SELECT DISTINCT * FROM (
SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'part_of' AS relation, 1.0::DOUBLE AS confidence FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'lives_in', 1.0 FROM customer UNION ALL SELECT 'customer:' || c_custkey, 'segment:' || c_mktsegment, 'belongs_to', 0.9 FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 1.0 FROM supplier UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'supports', 0.8 FROM orders
UNION ALL SELECT 'order:' || o_orderkey, 'priority:' || o_orderpriority, 'assesses', 0.7 FROM orders UNION ALL SELECT 'part:' || p_partkey, 'brand:' || p_brand, 'example_of', 0.9 FROM part
UNION ALL SELECT 'part:' || p_partkey, 'type:' || p_type, 'defines', 0.6 FROM part UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'teaches', 0.8 FROM lineitem
UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'explains', 0.75 FROM lineitem))"""


def _graph(spark, sf):
    t = lambda name: table(spark, sf, name)
    return B.together(
        B.edges(t("nation"), ("nation", "n_nationkey"), ("region", "n_regionkey"), "part_of"),
        B.edges(t("customer"), ("customer", "c_custkey"), ("nation", "c_nationkey"), "lives_in"),
        B.edges(t("customer"), ("customer", "c_custkey"), ("segment", "c_mktsegment"), "belongs_to", 0.9),
        B.edges(t("supplier"), ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "located_in"),
        B.edges(t("orders"), ("order", "o_orderkey"), ("customer", "o_custkey"), "supports", 0.8),
        B.edges(t("orders"), ("order", "o_orderkey"), ("priority", "o_orderpriority"), "assesses", 0.7),
        B.edges(t("part"), ("part", "p_partkey"), ("brand", "p_brand"), "example_of", 0.9),
        B.edges(t("part"), ("part", "p_partkey"), ("type", "p_type"), "defines", 0.6),
        B.edges(t("lineitem"), ("order", "l_orderkey"), ("part", "l_partkey"), "teaches", 0.8),
        B.edges(t("lineitem"), ("supplier", "l_suppkey"), ("part", "l_partkey"), "explains", 0.75),
    )


@query(f"WITH {GRAPH} SELECT * FROM gr")
def property_graph(spark, sf):
    return _graph(spark, sf)


@query(f"""WITH {GRAPH}, n AS (SELECT source AS n FROM gr UNION SELECT target FROM gr) SELECT 'node' AS what, split_part(n, ':', 1) AS kind, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'edge', relation, count(*) FROM gr GROUP BY ALL""")
def graph_audit(spark, sf):
    g = _graph(spark, sf)
    nodes = g.select(F.col("source").alias("n")).unionByName(g.select(F.col("target").alias("n"))).distinct()
    kinds = nodes.groupBy(F.substring_index("n", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    return kinds.unionByName(g.groupBy(F.col("relation").alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), "kind", "n"))


@query(f"""WITH {GRAPH}, l AS (SELECT source AS scope, source || ' -[' || relation || ']-> ' || target AS line, row_number() OVER w AS at_, sum(length(source || ' -[' || relation || ']-> ' || target) + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS used
  FROM gr WHERE starts_with(source, 'supplier:') WINDOW w AS (PARTITION BY source ORDER BY confidence DESC, source, relation, target))
SELECT scope, count(*) AS n_edges, string_agg(line, chr(10) ORDER BY at_) AS text FROM l WHERE used <= 400 GROUP BY scope""")
def graph_texts(spark, sf):
    g = _graph(spark, sf).where(F.startswith("source", F.lit("supplier:"))).withColumn("scope", F.col("source"))
    return B.graph_text(g, "scope", 400)


@query(f"""WITH c AS (SELECT doc_id AS chunk, unnest(list_distinct({TOKENS})) AS w FROM documents), l0 AS (SELECT item_id AS lesson, list_slice(list_filter({TOKENS}, lambda x: length(x) >= 5), 1, 4) AS t FROM benchmark),
l AS (SELECT lesson, len(list_distinct(t)) AS n, unnest(list_distinct(t)) AS w FROM l0), h AS (SELECT lesson, chunk, n, count(*) AS hits FROM c JOIN l USING (w) GROUP BY ALL HAVING count(*) >= least(2, n)),
f AS (SELECT chunk, min(lesson) AS lesson, min_by(hits, lesson) AS hits FROM h GROUP BY chunk) SELECT lesson, chunk, CAST(row_number() OVER (PARTITION BY lesson ORDER BY hits DESC, chunk) AS INT) AS rank FROM f QUALIFY rank <= 12""")
def lesson_evidence(spark, sf):
    words = F.slice(F.filter(tokens(F.col("text")), lambda x: F.length(x) >= 5), 1, 4)
    lessons = table(spark, sf, "benchmark").select(F.col("item_id").alias("lesson"), words.alias("words"))
    return B.lesson_evidence(O.supported(_docs(spark, sf).select(F.col("doc_id").alias("chunk"), tokens(F.col("text")).alias("words")), lessons))


_ST = """list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?])\\s+([A-Z0-9"(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s, ' -*#|')), lambda s: s <> '')"""


@query(f"""{R}, s AS (SELECT doc_id, section, list_filter({_ST}, lambda x: length(x) >= 30)[1] AS answer FROM se), t AS (SELECT * FROM s WHERE answer IS NOT NULL),
o AS (SELECT doc_id, section, answer, CAST(row_number() OVER w AS INT) AS pos, list_filter([lead(answer, 1) OVER w, lead(answer, 2) OVER w, lead(answer, 3) OVER w, lag(answer, 1) OVER w, lag(answer, 2) OVER w, lag(answer, 3) OVER w], lambda x: x IS NOT NULL) AS l FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY section)),
p AS (SELECT doc_id, section, pos, answer, list_prepend(answer, l) AS l FROM o WHERE pos <= 5), q AS (SELECT *, list_filter(l, lambda v, i: list_position(l, v) = i)[1:4] AS options FROM p)
SELECT doc_id, section, pos, md5(array_to_string(options, '|')) AS options, CAST(len(options) AS INT) AS n FROM q WHERE len(options) >= 2""")
def fallback_quiz(spark, sf):
    q = B.fallback_questions(_sections(spark, sf), least=30)
    return q.select("doc_id", "section", "pos", F.md5(F.array_join("options", "|")).alias("options"), F.size("options").alias("n"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(answer), '{p}') THEN '{n}'" for n, p in B.KINDS) + " ELSE 'fact' END"


@query(f"""{R}, s AS (SELECT doc_id, section, unnest({_ST}) AS answer, unnest(range(0, len({_ST}))) AS pos FROM se), k AS (SELECT doc_id, section, CAST(pos AS INT) AS pos, answer, {_KIND} AS kind FROM s WHERE length(answer) >= 24)
SELECT doc_id, section, pos, kind, answer FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, kind, lower(answer) ORDER BY section, pos) = 1""")
def knowledge_items(spark, sf):
    return B.knowledge_items(_sections(spark, sf))


@query(f"""WITH t AS (SELECT p_brand, p_partkey AS k, list_distinct(string_split({KEY.format("p_name || ' ' || p_type")}, ' ')) AS w FROM part)
SELECT x.p_brand, x.k AS a, y.k AS b FROM t x JOIN t y ON y.p_brand = x.p_brand AND x.k < y.k AND len(list_intersect(x.w, y.w)) >= 0.75 * greatest(len(x.w), len(y.w)) AND len(list_intersect(x.w, y.w)) > 0""")
def similar_titles(spark, sf):
    return B.similar_titles(table(spark, sf, "part").withColumn("t", F.concat_ws(" ", "p_name", "p_type")), "p_brand", "p_partkey", "t")


@query(f"""WITH o AS (SELECT {KEY.format('p_name')} AS k, min(upper(p_name)) AS old FROM part WHERE p_size < 10 GROUP BY ALL) SELECT p_partkey, coalesce(old, p_name) AS name FROM part LEFT JOIN o ON o.k = {KEY.format('p_name')}""")
def kept_concept_names(spark, sf):
    p = table(spark, sf, "part")
    former = p.where("p_size < 10").select(F.upper("p_name").alias("name"))
    return B.keep_names(p.select("p_partkey", F.col("p_name").alias("name")), former, "p_partkey", "name")


@query("""WITH s AS (SELECT a.label, a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1),
f AS (SELECT *, CASE WHEN coalesce(s <= 0.3 AND s <= coalesce(lag(s) OVER w, 2) AND s <= coalesce(lead(s) OVER w, 2), false) THEN 1 ELSE 0 END AS e FROM s WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label, vec_id, CAST(coalesce(sum(e) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk FROM f""")
def semantic_valleys(spark, sf):
    e = table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    s = e.join(after, "vec_id", "left").select("label", "vec_id", F.when(F.col("after").isNotNull(), F.round(cosine(F.col("embedding"), F.col("after")), 6)).alias("s"))
    return B.valleys(s, "label", "vec_id", "s", 0.3).select("label", "vec_id", "chunk")


_W = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'))"


@query(f"""WITH i AS (SELECT p_partkey AS item, unnest({_W.format("p_name || ' ' || p_type")}) AS w FROM part), t AS (SELECT p_partkey AS target, unnest({_W.format("p_name || ' ' || p_brand")}) AS w FROM part WHERE p_partkey % 20 = 0),
n AS (SELECT item, target, count(*) AS overlap FROM i JOIN t USING (w) GROUP BY ALL), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY item ORDER BY overlap DESC, target) = 1)
SELECT item, target, overlap, CAST(row_number() OVER (PARTITION BY target ORDER BY overlap DESC, item) AS INT) AS pos FROM b QUALIFY pos <= 7""")
def detail_attachment(spark, sf):
    p = table(spark, sf, "part")
    items = p.select(F.col("p_partkey").alias("item"), tokens(F.concat_ws(" ", "p_name", "p_type")).alias("words"))
    nodes = p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("target"), tokens(F.concat_ws(" ", "p_name", "p_brand")).alias("words"))
    return B.attached(O.best_match(items, nodes))


@query("""WITH m AS (SELECT p_brand, p_partkey AS at_, p_name FROM part WHERE p_size > 25), f AS (SELECT p_brand, p_partkey AS at_, p_name FROM part WHERE p_size <= 25),
b AS (SELECT p_brand, 0 AS part, at_, p_name FROM m UNION ALL SELECT p_brand, 1, at_, p_name FROM f), g AS (SELECT p_brand, p_name, min(struct_pack(p := part, a := at_)) AS f FROM b GROUP BY ALL)
SELECT p_brand, p_name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY f, p_name) AS INT) AS pos FROM g QUALIFY pos <= 6""")
def question_top_up(spark, sf):
    p = table(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("at_"), "p_name", "p_size")
    return B.top_up(p.where("p_size > 25"), p.where("p_size <= 25"), "p_brand", "at_", "p_name", 6)


@query("""WITH c AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part)
SELECT p_brand, p_partkey, ['mcq', 'true_false', 'fill_blank'][i % 3 + 1] AS kind, ['easy', 'medium', 'hard', 'medium'][i % 4 + 1] AS difficulty, ['recall', 'apply', 'explain', 'compare', 'order'][i % 5 + 1] AS skill FROM c""")
def quiz_rotation(spark, sf):
    """Three rotations of different lengths, so that their combinations differ for long."""
    i = (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("i")
    turn = lambda values: F.get(F.array(*map(F.lit, values)), F.col("i") % len(values))
    c = table(spark, sf, "part").select("p_brand", "p_partkey", i)
    return c.select(
        "p_brand", "p_partkey", turn(("mcq", "true_false", "fill_blank")).alias("kind"), turn(("easy", "medium", "hard", "medium")).alias("difficulty"),
        turn(("recall", "apply", "explain", "compare", "order")).alias("skill"),
    )
