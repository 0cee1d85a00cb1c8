"""Scans, replacements, deletions and logs of stored content on the driver's tables, with DuckDB SQL for the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import content as N
from corpusloom.operators import structure as S
from corpusloom.plans.course import FEATURES, _sections
from corpusloom.plans.registry import _docs, query, table

_BARE = r"regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<![^>]*>', ' ', 'g')"
_TEXT = f"array_to_string(list_filter(list_transform(string_split(regexp_replace({_BARE}, '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))"


@query(f"""SELECT page_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT page_id, replace(replace(replace(replace(replace(replace({_TEXT}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM pages)""")
def html_to_text(spark, sf):
    p = table(spark, sf, "pages").select("page_id", N.html_to_text(F.col("html")).alias("t"))
    return p.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


@query("SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS chunk_index, n_chars FROM documents WHERE source IN ('src0', 'src5', 'src7')")
def scan_files(spark, sf):
    from pyspark.sql import Window

    d = N.scan(_docs(spark, sf), "source", [" src0", "src5", "src0", "", "src7"])
    return d.select("source", "doc_id", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("chunk_index"), "n_chars")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 6)")
def scan_of_parents(spark, sf):
    c = table(spark, sf, "conversations")
    long = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 6")
    return N.of_parents(c.select("conv_id", "turn", "role"), long, "conv_id")


@query("""WITH f AS (SELECT source, doc_id + 1000000 AS doc_id FROM documents WHERE source LIKE 'src1%' AND doc_id % 3 = 0)
SELECT source, count(*) AS n, max(doc_id) AS last FROM (SELECT source, doc_id FROM documents WHERE source NOT IN (SELECT source FROM f) UNION ALL SELECT * FROM f) GROUP BY ALL""")
def document_replacement(spark, sf):
    d = _docs(spark, sf).select("source", "doc_id")
    fresh = d.where("source LIKE 'src1%' AND doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    return N.replaced(d, fresh, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))


@query("""WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM g))
SELECT 'customer' AS kind, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM g) UNION ALL SELECT 'orders', count(*) FROM o
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM g))""")
def cascade_delete(spark, sf):
    c, o, l = (table(spark, sf, x) for x in ("customer", "orders", "lineitem"))  # noqa: E741
    gone = c.where("c_acctbal < 0").select("c_custkey")
    left = N.without({"customer": (c, "c_custkey"), "orders": (o, "o_custkey")}, gone, "c_custkey")
    lost = o.join(gone.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left_semi").select("o_orderkey")
    left |= N.without({"lineitem": (l, "l_orderkey")}, lost, "o_orderkey")
    parts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n") for name, rows in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _vectors(spark, sf):
    e, k = table(spark, sf, "embeddings"), F.col("vec_id")
    stored = e.select(k, "embedding", F.when(k % 5 == 0, "old").otherwise("m1").alias("model"), F.size("embedding").alias("dim"))
    return N.upsert_vectors(stored, e.where("vec_id % 3 = 0").select("vec_id", F.reverse("embedding").alias("embedding")), "vec_id", "m1", 64)


@query("""WITH d AS (SELECT vec_id, len(embedding) AS dim FROM embeddings) SELECT vec_id, 'm1' AS model, CAST(dim AS INT) AS dim, vec_id % 3 = 0 AS fresh FROM d WHERE (vec_id % 5 <> 0 OR vec_id % 3 = 0) AND dim = 64""")
def vector_upsert(spark, sf):
    return _vectors(spark, sf).select("vec_id", "model", "dim", (F.col("vec_id") % 3 == 0).alias("fresh"))


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'old' ELSE 'm1' END AS model FROM embeddings)
SELECT source, count(*) AS total, count(*) FILTER (model = 'm1') AS embedded, count(*) FILTER (model <> 'm1') AS stale, count(*) FILTER (model = 'm1') = count(*) AS ready FROM documents LEFT JOIN v ON vec_id = doc_id GROUP BY source""")
def vector_index_status(spark, sf):
    e, k = table(spark, sf, "embeddings"), F.col("vec_id")
    stored = e.select(k.alias("doc_id"), F.when(k % 5 == 0, "old").otherwise("m1").alias("model"), F.lit(64).alias("dim"))
    return N.vector_status(stored, _docs(spark, sf), "doc_id", "source", "m1", 64)


@query("""WITH s AS (SELECT o_orderkey, ['uploaded', 'parsing', 'chunking', 'embedding', 'ready', 'failed'][o_orderkey % 6 + 1] AS s, o_orderstatus = 'F' AS f, o_orderpriority LIKE '1%' AS r FROM orders)
SELECT s AS state, CASE WHEN s = 'failed' THEN CASE WHEN r THEN 'uploaded' ELSE 'failed' END WHEN f AND s <> 'ready' THEN 'failed' WHEN s = 'uploaded' THEN 'parsing' WHEN s = 'parsing' THEN 'chunking' WHEN s = 'chunking' THEN 'embedding' ELSE 'ready' END AS next, count(*) AS n FROM s GROUP BY ALL""")
def file_state_machine(spark, sf):
    states = F.array(*map(F.lit, (*N.STATES, "failed")))
    o = table(spark, sf, "orders").select(F.get(states, (F.col("o_orderkey") % 6).cast("int")).alias("state"), (F.col("o_orderstatus") == "F").alias("f"), F.col("o_orderpriority").like("1%").alias("r"))
    return o.groupBy("state", N.next_state(F.col("state"), F.col("f"), F.col("r")).alias("next")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT user_id, event_id, greatest(0, least(100, CAST(trunc(value * 1.2 - 10) AS INT))) AS p FROM events) SELECT user_id, max_by(p, event_id) AS percent, count(*) AS n_events, max(event_id) AS last FROM e GROUP BY ALL""")
def progress_event_log(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("value") * 1.2 - 10).alias("p"))
    return N.progress_log(e, "user_id", "event_id", "p")


@query(f"""{FEATURES}, u AS (SELECT doc_id, section, 'formula' AS kind, unnest(equations) AS value, unnest(range(0, len(equations))) AS pos FROM fe UNION ALL SELECT doc_id, section, 'timeline', unnest(dated), unnest(range(0, len(dated))) FROM fe
UNION ALL SELECT doc_id, section, 'concept', unnest(concepts), unnest(range(0, len(concepts))) FROM fe) SELECT doc_id, section, kind, CAST(pos AS INT) AS pos, value FROM u""")
def content_features(spark, sf):
    t = F.col("text")
    return N.feature_rows(_sections(spark, sf), {"formula": S.equations(t), "timeline": S.dated_lines(t), "concept": S.key_concepts(t)})


@query("""WITH j AS (SELECT event_id, ['running', 'ready', 'parsing', 'failed'][event_id % 4 + 1] AS s, ts FROM events), n AS (SELECT max(ts) AS n FROM events) SELECT event_id, s AS status FROM j, n WHERE s IN ('parsing', 'chunking', 'embedding', 'running') AND epoch(n) // 1 - epoch(ts) // 1 > 600""")
def interrupted_jobs(spark, sf):
    states = F.array(*map(F.lit, ("running", "ready", "parsing", "failed")))
    e = table(spark, sf, "events").select("event_id", F.get(states, (F.col("event_id") % 4).cast("int")).alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    return N.interrupted(e.crossJoin(F.broadcast(now)), "status", "ts", F.col("now"), 10).select("event_id", "status")


@query("""SELECT doc_id, source, sha256(text) AS text_hash, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 80) AS preview FROM documents""")
def corpus_dump(spark, sf):
    preview = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 80)
    return _docs(spark, sf).select("doc_id", "source", F.sha2("text", 256).alias("text_hash"), preview.alias("preview"))
