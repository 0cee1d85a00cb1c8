"""Kinds of courses and rules for what is shown, on the driver's tables and texts that Spark derives from them, with DuckDB SQL for the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import architecture as A
from corpusloom.plans.registry import query, table

#: What an order of each kind says; every branch of the rule occurs among customers.
SAID = (
    "The dynasty and its empire fell after the war of 1453 and the treaty.", "An atom and a molecule meet in this reaction of an acid.\n2H_2 + O_2 -> 2H_2O",
    "Newton gave the force and the momentum of a wave in physics.", "A theorem of algebra has a proof by a lemma on the matrix.",
    "The cell has an enzyme and a protein next to its dna.", "Follow the operating procedure step by step in this workflow and protocol.",
    "Machine learning software ranks by an algorithm, a recommender of computer science.", "Nothing of note in 1998 was said here.",
)


def _said(key):
    return F.element_at(F.array(*map(F.lit, SAID)), (F.pmod(key, F.lit(len(SAID))) + 1).cast("int"))


_LIST = "[" + ", ".join("'" + s.replace("\n", "' || chr(10) || '") + "'" for s in SAID) + "]"


def _uses(words):
    groups = ([w for w in words if " " not in w], [w for w in words if " " in w])
    return " + ".join(rf"len(regexp_extract_all(t, '\b(?:{'|'.join(g)})\b'))" for g in groups if g)


_COUNTS = ", ".join([f"sum({_uses(w)}) AS k_{k}" for k, w in A.KEYWORDS.items()] + [f"sum({_uses(w)}) AS a_{k}" for k, w in A.ANCHORS.items()])
_EXTRA = {
    "historical": "CASE WHEN dated >= greatest(3, n // 3) THEN 4 ELSE 0 END", "chemistry": "CASE WHEN a_chemistry > 0 THEN 3 * reactions ELSE 0 END",
    "physics": "CASE WHEN a_physics > 0 AND k_physics + a_physics > 0 THEN least(4, formulas) ELSE 0 END",
}
_SCORES = " UNION ALL ".join(
    f"SELECT course, {i} AS i, '{k}' AS kind, (CASE WHEN a_{k} = 0 THEN 0 ELSE k_{k} + least(8, 2 * a_{k}) END) + {_EXTRA.get(k, '0')} AS s FROM g" for i, k in enumerate(A.KEYWORDS)
)


@query(f"""WITH c AS (SELECT o_custkey AS course, {_LIST}[CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 3 ELSE o_custkey END % {len(SAID)} + 1] AS text, o_orderkey % 2 AS e FROM orders),
u AS (SELECT course, lower(text) AS t, text, e, 1 AS n FROM c UNION ALL SELECT c_custkey, lower(c_mktsegment || ' history'), '', 0, 0 FROM customer WHERE c_custkey % 5 = 0),
g AS (SELECT course, {_COUNTS}, sum({_uses(A.SIGNALS)}) AS signals, count(*) FILTER (regexp_matches(text, '\\b\\d{{3,4}}\\b')) AS dated, count(*) FILTER (contains(text, '->')) AS reactions,
  sum(e) AS formulas, sum(n) AS n FROM u GROUP BY course),
s AS ({_SCORES}), r AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY s DESC, i) AS r FROM s),
f AS (SELECT course, max(s) FILTER (r = 1) AS s1, max(s) FILTER (r = 2) AS s2, max(kind) FILTER (r = 1) AS best FROM r GROUP BY course)
SELECT course, CASE WHEN signals >= greatest(4, 2 * greatest({', '.join(f'a_{k}' for k in A.ANCHORS)})) OR s1 < 3 THEN 'conceptual' WHEN s2 >= greatest(3, 0.8 * s1) THEN 'mixed' ELSE best END AS architecture,
best, CAST(s1 AS BIGINT) AS score FROM f JOIN g USING (course)""")
def course_architecture(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    key = F.when(F.col("o_orderkey") % 3 == 0, F.floor(F.col("o_orderkey") / 3)).otherwise(F.col("o_custkey"))
    none = F.lit(None).cast("string")
    chunks = o.select(F.col("o_custkey").alias("course"), none.alias("heading"), none.alias("concepts"), _said(key).alias("text"), (F.col("o_orderkey") % 2).cast("int").alias("n_equations"))
    labels = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("course"), F.concat("c_mktsegment", F.lit(" history")).alias("text"))
    return A.course_architecture(chunks, labels)


_TITLES = ("Introduction", "{}", "3.{}", "{}) parts", "Phase {} of <b>it</b>", "Planning the year {}", "score: {}", "question", "p", "Cost ${}$")
_TITLE = "replace([" + ", ".join(f"'{t}'" for t in _TITLES) + f"][o_orderkey % {len(_TITLES)} + 1], '{{}}', CAST(o_custkey AS VARCHAR))"


@query(f"""WITH t AS (SELECT o_orderkey AS phase, {_TITLE} AS title, lower({_TITLE}) AS k FROM orders)
SELECT phase, length(title) >= 2 AND NOT regexp_matches(title, '[$\\\\{{}}<>]|^[0-9]+([.][0-9]+)*$') AND k NOT IN ('introduction') AS valid,
regexp_matches(k, '</?[a-z]+|[$\\\\{{}}]|^[0-9]+[).:-]|^[a-z]$|^score:') OR k = 'question' AS granular FROM t""")
def phase_titles(spark, sf):
    at = (F.col("o_orderkey") % len(_TITLES) + 1).cast("int")
    title = F.replace(F.element_at(F.array(*map(F.lit, _TITLES)), at), F.lit("{}"), F.col("o_custkey").cast("string"))
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("phase"), title.alias("title"))
    return d.select("phase", A.valid_phase_title(F.col("title")).alias("valid"), A.too_granular(F.col("title")).alias("granular"))


@query("""SELECT l_orderkey AS phase, count(*) AS n_objectives FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N' AND o_orderstatus <> 'P' GROUP BY ALL""")
def active_objectives(spark, sf):
    phases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("phase"), (F.col("o_orderstatus") == "P").alias("inactive"))
    objectives = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("phase"), (F.col("l_returnflag") == "N").alias("inactive"))
    return A.active_map(phases, objectives)[1].groupBy("phase").agg(F.count(F.lit(1)).alias("n_objectives"))


_ASKED = ("hello", "Hi there", "How is it  made", "weather in the large ring", "a movie about rings?", "what is the exchange rate", "OK", "please compare the plan")
_AL = "[" + ", ".join(f"'{t}'" for t in _ASKED) + f"][p_partkey % {len(_ASKED)} + 1]"


@query(f"""WITH m AS (SELECT p_partkey AS message, lower({_AL}) AS t, p_partkey % {len(_ASKED)} AS i, lower(p_name) AS n, CASE WHEN p_size % 3 = 0 THEN 'retrieve' ELSE 'conversational_reply' END AS a FROM part)
SELECT message, CASE WHEN a = 'retrieve' OR i IN (0, 1, 3, 6) THEN a WHEN i IN (4, 5) AND NOT list_has_any(regexp_extract_all(t, '[a-z][a-z0-9+/#-]{{2,}}'), regexp_extract_all(n, '[a-z][a-z0-9+/#-]{{2,}}')) THEN 'outside_files' ELSE 'retrieve' END AS route FROM m""")
def guarded_routes(spark, sf):
    said = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("p_partkey") % len(_ASKED) + 1).cast("int"))
    action = F.when(F.col("p_size") % 3 == 0, "retrieve").otherwise("conversational_reply")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("message"), A.guarded_route(action, said, F.col("p_name")).alias("route"))


@query("""WITH k AS (SELECT l_orderkey AS node, bool_or(l_suppkey % 4 = 0) AS c, bool_or(l_partkey % 11 = 0) AS f FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS node, ['course', 'chunk', 'file', 'concept'][o_orderkey % 4 + 1] AS kind FROM orders LEFT JOIN k ON node = o_orderkey
WHERE coalesce(c, false) OR coalesce(f, false) OR o_orderkey % 4 = 0 OR o_orderkey % 4 = 1 AND o_custkey % 4 = 0 AND o_custkey IN (SELECT s_suppkey FROM supplier) OR o_orderkey % 4 = 2 AND o_custkey % 11 = 0 AND o_custkey IN (SELECT p_partkey FROM part)""")
def nodes_in_scope(spark, sf):
    s = lambda c: F.col(c).cast("string")
    ids = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("node")).agg(F.collect_set(s("l_suppkey")).alias("chunk_ids"), F.collect_set(s("l_partkey")).alias("file_ids"))
    kind = F.element_at(F.array(*map(F.lit, ("course", "chunk", "file", "concept"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    nodes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), kind.alias("kind"), s("o_custkey").alias("ref")).join(ids, "node", "left")
    chunks = table(spark, sf, "supplier").where("s_suppkey % 4 = 0").select(s("s_suppkey").alias("chunk"))
    files = table(spark, sf, "part").where("p_partkey % 11 = 0").select(s("p_partkey").alias("file"))
    return A.in_source_scope(nodes, chunks, files).select("node", "kind")
