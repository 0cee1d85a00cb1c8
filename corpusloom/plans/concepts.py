"""Concept inventories on the driver's tables, with DuckDB SQL for the same results. Parts stand for concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import concepts as C
from corpusloom.plans.registry import query, table

KEY = "array_to_string(regexp_extract_all(strip_accents(lower({})), '[a-z0-9]+'), ' ')"


def _first_words(n: int = 6):
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, n), " ")


@query(f"""WITH t AS (SELECT doc_id, array_to_string(list_slice(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1, 6), ' ') AS t FROM documents)
SELECT doc_id, {KEY.format('t')} AS key FROM t""")
def accent_folded_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.concept_key(_first_words()).alias("key"))


NAMES = """nm AS (SELECT p_partkey AS id, 0 AS kind, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS name, p_name || ' ' || p_type AS context FROM part
UNION ALL SELECT p_partkey, 1, p_type, p_name FROM part UNION ALL SELECT p_partkey, 2, p_brand, p_name FROM part
UNION ALL SELECT p_partkey, 3, p_name || ' and ' || p_name || ' of all', p_name FROM part UNION ALL SELECT p_partkey, 4, 'With ' || p_name, p_name FROM part
UNION ALL SELECT p_partkey, 5, upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2), CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'none' END FROM part
UNION ALL SELECT p_partkey, 6, 'the ' || p_name || ' is sold.', p_name FROM part UNION ALL SELECT p_partkey, 7, split_part(p_name, ' ', 2), p_name FROM part)"""


def _names(spark, sf):
    p = table(spark, sf, "part")
    n, second = F.col("p_name"), F.col("p_name")
    capital = lambda x: F.concat(F.upper(F.substring(n, 1, 1)), F.substring(x, 2, 200))
    word = lambda i: F.coalesce(F.get(F.split(n, " "), F.lit(i)), F.lit(""))
    forms = [
        (capital(n), F.concat(n, F.lit(" "), "p_type")), (F.col("p_type"), n), (F.col("p_brand"), n),
        (F.concat(n, F.lit(" and "), n, F.lit(" of all")), n), (F.concat(F.lit("With "), n), n),
        (capital(word(0)), F.when(F.col("p_partkey") % 2 == 0, n).otherwise("none")),
        (F.concat(F.lit("the "), n, F.lit(" is sold.")), n), (word(1), second),
    ]
    each = F.array(*[F.struct(F.lit(i).alias("kind"), a.alias("name"), b.alias("context")) for i, (a, b) in enumerate(forms)])
    return p.select(F.col("p_partkey").alias("id"), F.explode(each).alias("f")).select("id", "f.*")


_SH = "(t = upper(t) AND length(t) BETWEEN 2 AND 10)"


@query(f"""WITH {NAMES}, a AS (SELECT id, kind, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS t, context FROM nm),
b AS (SELECT *, {KEY.format('t')} AS key, len(string_split({KEY.format('t')}, ' ')) AS n, regexp_replace(t, '[^A-Za-z0-9]', '', 'g') AS c FROM a),
v AS (SELECT id, kind, length(t) BETWEEN 2 AND 120 AND key <> '' AND NOT regexp_matches(t, '{C.BAD_MARKS}') AND n <= 8
  AND (n > 1 OR (length(key) >= 3 AND ({_SH} OR (regexp_matches(substr(c, 2, 100), '[A-Z]') AND length(c) BETWEEN 2 AND 10) OR (regexp_matches(t, '^\\p{{Lu}}') AND t <> upper(t) AND contains({KEY.format('context')}, key)))))
  AND (NOT (regexp_matches(t, '[.?!;]') OR (len(string_split(t, ' ')) >= 6 AND regexp_matches(t, '^\\p{{Ll}}')) OR lower(split_part(t, ' ', 1)) IN {tuple(C.FRAGMENT_STARTS)}) OR (n BETWEEN 2 AND 4 AND regexp_matches(t, '(^| )\\p{{Lu}}')))
  AND ({_SH} OR (len(list_filter(string_split(key, ' '), lambda w: length(w) > 2)) > 0 AND (n <= 4 OR (n <= 8 AND regexp_matches(t, '(^| )\\p{{Lu}}'))))) AS valid FROM b)
SELECT id, kind, coalesce(valid, false) AS valid FROM v""")
def concept_name_validity(spark, sf):
    return _names(spark, sf).select("id", "kind", C.valid_name(F.col("name"), F.col("context")).alias("valid"))


@query(f"""WITH RECURSIVE c AS (SELECT p_brand AS scope, p_name AS name, upper(substr(split_part(p_name, ' ', 1), 1, 2) || substr(split_part(p_name, ' ', 2), 1, 1)) AS alias, p_size / 50.0::DOUBLE AS importance, p_partkey AS source FROM part),
k AS (SELECT DISTINCT scope, {KEY.format('name')} AS key, {KEY.format('alias')} AS other FROM c),
e AS (SELECT scope, key AS a, other AS b FROM k UNION SELECT scope, other, key FROM k),
r AS (SELECT scope, a AS n, a AS m FROM e UNION SELECT r.scope, r.n, e.b FROM r JOIN e ON e.scope = r.scope AND e.a = r.m),
g AS (SELECT scope, n, min(m) AS component FROM r GROUP BY ALL)
SELECT c.scope, max_by(name, struct_pack(i := importance, n := length(name), b := translate(name, '{C._LETTERS.replace("'", "''")}', '{C._LETTERS[::-1].replace("'", "''")}'))) AS name, max(importance) AS importance, count(DISTINCT name) AS n_names, count(DISTINCT source) AS n_sources
FROM c JOIN g ON g.scope = c.scope AND g.n = {KEY.format('c.name')} GROUP BY c.scope, component""")
def concept_merge(spark, sf):
    first, second = (F.get(F.split("p_name", " "), F.lit(i)) for i in (0, 1))
    short = F.upper(F.concat(F.substring(first, 1, 2), F.substring(F.coalesce(second, F.lit("")), 1, 1)))
    p = table(spark, sf, "part").select(
        F.col("p_brand").alias("scope"), F.col("p_name").alias("name"), F.array(short).alias("aliases"), (F.col("p_size") / 50.0).alias("importance"), F.col("p_partkey").alias("source")
    )
    return C.merge(p)


@query("""SELECT p_brand, min_by(n, p_partkey) AS name, count(*) AS n FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS n FROM part) GROUP BY p_brand, lower(n)""")
def concept_first_spelling(spark, sf):
    p = table(spark, sf, "part").withColumn("name", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    return C.first_spelling(p, "p_brand", "name", "p_partkey")


def _labels(spark, sf):
    """Names as users write them: with a letter doubled or left out, in capitals, or with marks."""
    n, k = F.col("p_name"), F.col("p_partkey")
    form = (
        F.when(k % 4 == 0, F.upper(n)).when(k % 4 == 1, F.concat(n, F.lit("s"))).when(k % 4 == 2, F.concat(F.substring(n, 1, 4), F.substring(n, 4, 100)))
        .otherwise(F.replace(n, F.lit(" "), F.lit("-")))
    )
    return table(spark, sf, "part").select(form.alias("label")).distinct()


def _known(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("concept"))


@query()
def concept_resolution(spark, sf):
    r = C.resolve(_labels(spark, sf), _known(spark, sf))
    return r.withColumn("score", F.round("score", 6))


@query(f"""WITH l AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || 's' WHEN 2 THEN substr(p_name, 1, 4) || substr(p_name, 4, 100) ELSE replace(p_name, ' ', '-') END AS label FROM part),
k AS (SELECT {KEY.format('p_name')} AS key, min(p_partkey) AS concept FROM part GROUP BY ALL)
SELECT label, concept FROM l LEFT JOIN k ON k.key = {KEY.format('label')}""")
def concept_by_alias(spark, sf):
    return C.by_alias(_labels(spark, sf), _known(spark, sf))


@query("""SELECT id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c_nationkey AS id, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY ALL
UNION ALL SELECT CAST(json_extract(props, '$.k') AS INT), count(*) FROM events GROUP BY ALL) GROUP BY id""")
def reference_counts(spark, sf):
    one = lambda name, c: table(spark, sf, name).select(F.col(c).alias("id"))
    keys = table(spark, sf, "events").select(F.from_json("props", "k int")["k"].alias("id"))
    return C.reference_counts(one("customer", "c_nationkey"), one("supplier", "s_nationkey"), keys)


@query("""WITH d AS (SELECT o_custkey AS id, count(*) % 5 AS v FROM orders GROUP BY ALL), e AS (SELECT user_id AS id, count(*) % 5 AS v FROM events GROUP BY ALL),
r AS (SELECT l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT id, CASE WHEN e.id IS NULL THEN 'insert' WHEN d.id IS NULL THEN CASE WHEN coalesce(n, 0) > 0 THEN 'deactivate' ELSE 'delete' END WHEN d.v = e.v THEN 'keep' ELSE 'update' END AS action
FROM d FULL JOIN e USING (id) LEFT JOIN r USING (id)""")
def reconcile_with_references(spark, sf):
    counted = lambda name, c: table(spark, sf, name).groupBy(F.col(c).cast("bigint").alias("id")).agg((F.count(F.lit(1)) % 5).alias("value"))
    used = C.reference_counts(table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("bigint").alias("id")))
    return C.reconcile(counted("orders", "o_custkey"), counted("events", "user_id"), used)


@query("""WITH d AS (SELECT l_suppkey AS source, l_partkey AS target, max(l_discount) AS confidence FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL),
e AS (SELECT l_suppkey AS source, l_partkey AS target, min(l_tax) AS confidence FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
SELECT source, target, coalesce(d.confidence, e.confidence) AS confidence, d.confidence IS NOT NULL AS active FROM d FULL JOIN e USING (source, target)""")
def reconcile_graph_edges(spark, sf):
    row = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), "l_discount", "l_tax", "l_returnflag")
    desired = row.where("l_returnflag != 'A'").groupBy("source", "target").agg(F.max("l_discount").alias("confidence"))
    existing = row.where("l_returnflag != 'R'").groupBy("source", "target").agg(F.min("l_tax").alias("confidence"))
    return C.upsert(existing, desired, ["source", "target"])


@query("""SELECT DISTINCT l_suppkey AS scope, p_brand AS concept FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'""")
def concepts_of_sources(spark, sf):
    c = table(spark, sf, "part").select(F.col("p_brand").alias("concept"), F.array("p_partkey").alias("sources"))
    return C.overlapping(c, table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("scope"), F.col("l_partkey").alias("source")))
