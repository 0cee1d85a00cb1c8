"""Evidence for lessons over the driver's documents, with DuckDB SQL for the same results: a recursive query takes the lessons one after the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators import allocation as A
from corpusloom.operators import outline as O
from corpusloom.plans.registry import TOKENS, _docs, query, stage, table

TURNS = f"""cw AS (SELECT doc_id AS chunk, unnest(list_distinct({TOKENS})) AS w FROM documents), l0 AS (SELECT item_id AS lesson, list_distinct(list_filter({TOKENS}, lambda x: length(x) >= 5)) AS t FROM benchmark),
lw AS (SELECT lesson, len(t) AS n, unnest(t) AS w FROM l0),
sp AS (SELECT lesson, chunk, count(*) AS score, chunk % 7 = 0 AS reusable FROM cw JOIN lw USING (w) GROUP BY lesson, chunk, n HAVING count(*) >= least(2, n)),
ls AS (SELECT lesson, row_number() OVER (ORDER BY lesson) AS k FROM (SELECT DISTINCT lesson FROM sp)),
tk AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS lesson, []::BIGINT[] AS got, []::BIGINT[] AS used
  UNION ALL SELECT n.k, n.lesson, n.got, list_concat(n.used, list_filter(n.got, lambda x: x % 7 <> 0)) FROM (
    SELECT t.k + 1 AS k, any_value(ls.lesson) AS lesson, list(sp.chunk ORDER BY sp.score DESC, sp.chunk) FILTER (sp.reusable OR NOT list_contains(t.used, sp.chunk)) AS g,
      coalesce(list_slice(list(sp.chunk ORDER BY sp.score DESC, sp.chunk) FILTER (sp.reusable OR NOT list_contains(t.used, sp.chunk)), 1, {A.CAPACITY}), []) AS got, any_value(t.used) AS used
    FROM tk t JOIN ls ON ls.k = t.k + 1 JOIN sp ON sp.lesson = ls.lesson GROUP BY t.k) n),
gv AS (SELECT lesson, unnest(got) AS chunk, generate_subscripts(got, 1) AS rank FROM tk WHERE lesson IS NOT NULL)"""


def _parts(spark, sf):
    chunks = stage(_docs(spark, sf).select(F.col("doc_id").alias("chunk"), "source", F.col("lang").alias("root"), tokens(F.col("text")).alias("words")), "chunks")
    words = F.filter(tokens(F.col("text")), lambda x: F.length(x) >= 5)
    lessons = table(spark, sf, "benchmark").select(F.col("item_id").alias("lesson"), words.alias("words"))
    pairs = O.supported(chunks.select("chunk", "words"), lessons).withColumnRenamed("hits", "score").withColumn("reusable", F.col("chunk") % 7 == 0)
    return chunks, lessons, A.allocated(pairs)


@query(f"WITH RECURSIVE {TURNS} SELECT lesson, chunk, CAST(rank AS INT) AS rank FROM gv")
def evidence_allocation(spark, sf):
    return _parts(spark, sf)[2].select("lesson", "chunk", "rank")


@query(f"""WITH RECURSIVE {TURNS}, rs AS (SELECT doc_id AS chunk, source, lang AS root FROM documents WHERE doc_id NOT IN (SELECT chunk FROM gv)),
ov AS (SELECT chunk, lesson, 2.0::DOUBLE * count(*) AS a FROM cw JOIN lw USING (w) GROUP BY ALL),
os AS (SELECT DISTINCT lesson, source FROM gv JOIN documents ON doc_id = chunk), og AS (SELECT DISTINCT lesson, lang AS root FROM gv JOIN documents ON doc_id = chunk),
sc AS (SELECT r.chunk, l.lesson, coalesce(a, 0) + CASE WHEN os.lesson IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN og.lesson IS NOT NULL THEN 0.5 ELSE 0 END AS affinity
  FROM rs r CROSS JOIN (SELECT item_id AS lesson FROM benchmark) l LEFT JOIN ov ON ov.chunk = r.chunk AND ov.lesson = l.lesson
  LEFT JOIN os ON os.lesson = l.lesson AND os.source = r.source LEFT JOIN og ON og.lesson = l.lesson AND og.root = r.root)
SELECT chunk, lesson, CAST(affinity AS DOUBLE) AS affinity FROM sc QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY affinity DESC, lesson) = 1""")
def evidence_coverage(spark, sf):
    return A.placed_chunks(*_parts(spark, sf))
