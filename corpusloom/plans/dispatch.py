"""Contexts for requests over the driver's conversations: a conversation is a scope, its rows are the chunks, its first row is the message."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import low_information, tokens
from corpusloom.operators import dispatch as D
from corpusloom.operators.retrieval import top_k
from corpusloom.plans.registry import TOKENS, query, stage, table

OUTPUTS = ("text", "quiz", "mindmap", "presentation", "podcast", "report", "chart", "chat")
_LOW = f"""(length(z) < 18 OR len({TOKENS.replace('text', 'z')}) <= 3 OR regexp_matches(lower(z), '^(page|slide)?\\s*\\d+(\\s*(/|of)\\s*\\d+)?$|^(thank you|questions)[.!?]*$')
  OR (length(regexp_replace(z, '[^\\p{{L}}]', '', 'g')) < 8 AND length(z) < 80) OR (len(list_distinct({TOKENS.replace('text', 'z')})) <= 2 AND length(z) < 80))"""
_RANK = "CAST(row_number() OVER (PARTITION BY request_id ORDER BY {} DESC, chunk_id) AS INT)"


@query(f"""WITH ck0 AS (SELECT conv_id AS scope, conv_id * 1000 + turn AS chunk_id, turn AS place, turn // 3 AS section, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS z FROM conversations),
ck AS (SELECT scope, chunk_id, place, section, {_LOW} AS low, list_distinct({TOKENS}) AS w FROM ck0),
rq0 AS (SELECT conv_id AS scope, conv_id AS request_id, {list(OUTPUTS)}[conv_id % 8 + 1] AS output_type, CASE WHEN conv_id % 3 = 0 THEN split_part(arg_min(text, turn), ' ', 1) END AS topic,
  CASE WHEN conv_id % 5 = 0 THEN 'Can you summarize this course?' WHEN conv_id % 5 = 1 THEN 'zzz' ELSE arg_min(text, turn) END AS message FROM conversations GROUP BY conv_id),
rq1 AS (SELECT *, CASE WHEN trim(coalesce(topic, '')) <> '' THEN trim(topic) ELSE trim(message) END AS q, trim(coalesce(topic, '')) = '' AS bare FROM rq0),
rq AS (SELECT *, CASE WHEN output_type IN ('quiz', 'mindmap') THEN 'full' WHEN output_type IN ('presentation', 'podcast') AND bare THEN 'sample'
  WHEN output_type IN ('text', 'chat') AND q = 'Can you summarize this course?' THEN 'sample' WHEN output_type IN ('podcast', 'presentation', 'report') AND q = '' THEN 'sample' ELSE 'fused' END AS route FROM rq1),
mt AS (SELECT request_id, chunk_id, len(list_intersect(w, list_distinct({TOKENS.replace('text', 'q')}))) AS n, len(w) AS m FROM rq JOIN ck USING (scope) WHERE route = 'fused'),
l1 AS (SELECT request_id, chunk_id, {_RANK.format('n')} AS rank FROM mt WHERE n > 0), l2 AS (SELECT request_id, chunk_id, {_RANK.format('round(n / m, 6)')} AS rank FROM mt WHERE n > 0),
g0 AS (SELECT r.request_id, c.chunk_id, c.place FROM rq r JOIN ck c USING (scope) WHERE c.place % 4 = 3), gr AS (SELECT request_id, chunk_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY chunk_id) AS INT) AS rank FROM g0),
fu AS (SELECT request_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS s FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY ALL),
hi AS (SELECT request_id, chunk_id, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, chunk_id) AS rank FROM fu QUALIFY rank <= 3),
td AS (SELECT * FROM ck JOIN (SELECT scope, bool_and(low) AS al FROM ck GROUP BY ALL) USING (scope) WHERE al OR NOT low),
sm AS (SELECT request_id, scope FROM rq WHERE route = 'sample' OR (route = 'fused' AND request_id NOT IN (SELECT request_id FROM hi))),
s1 AS (SELECT *, row_number() OVER (PARTITION BY scope, section ORDER BY place, chunk_id) > 1 AS later FROM td), s2 AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY later, place, chunk_id) AS r FROM s1),
pt AS (SELECT request_id, 0 AS step, place, chunk_id, 'full' AS origin FROM rq JOIN ck USING (scope) WHERE route = 'full'
  UNION ALL SELECT request_id, 1, rank, chunk_id, 'graph' FROM gr JOIN rq USING (request_id) WHERE route = 'full'
  UNION ALL SELECT request_id, 2, place, chunk_id, 'sample' FROM sm JOIN s2 USING (scope) WHERE r <= 4
  UNION ALL SELECT request_id, 3, rank, chunk_id, 'graph' FROM gr WHERE rank <= 1 AND request_id IN (SELECT request_id FROM hi)
  UNION ALL SELECT request_id, 4, rank, chunk_id, 'list' FROM hi
  UNION ALL SELECT h.request_id, 5, h.rank * 2 + (o.d + 1) // 2, b.chunk_id, 'neighbour' FROM hi h JOIN rq USING (request_id) JOIN td a ON a.scope = rq.scope AND a.chunk_id = h.chunk_id, (VALUES (-1), (1)) o(d)
    JOIN td b ON b.scope = a.scope AND b.section = a.section AND b.place = a.place + o.d),
ft AS (SELECT request_id, chunk_id, min(struct_pack(step := step, place := place, origin := origin)) AS f FROM pt GROUP BY ALL)
SELECT request_id, route, CAST(row_number() OVER (PARTITION BY request_id ORDER BY f.step, f.place, chunk_id) AS INT) AS pos, chunk_id, f.origin AS origin FROM ft JOIN rq USING (request_id)""")
def output_contexts(spark, sf):
    c = F.col
    t = table(spark, sf, "conversations")
    chunks = t.select(c("conv_id").alias("scope"), (c("conv_id") * 1000 + c("turn")).alias("chunk_id"), c("turn").alias("at"), F.floor(c("turn") / 3).alias("section"), low_information(c("text")).alias("low"), F.array_distinct(tokens(c("text"))).alias("w"))
    first = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    topic = F.when(c("conv_id") % 3 == 0, F.split_part(c("text"), F.lit(" "), F.lit(1)))
    message = F.when(c("conv_id") % 5 == 0, "Can you summarize this course?").when(c("conv_id") % 5 == 1, "zzz").otherwise(c("text"))
    output = F.get(F.array(*map(F.lit, OUTPUTS)), (c("conv_id") % 8).cast("int"))
    requests = stage(D.dispatched(first.select(c("conv_id").alias("scope"), c("conv_id").alias("request_id"), output.alias("output_type"), topic.alias("topic"), message.alias("message"))), "requests")
    chunks = stage(chunks, "chunks")
    asked = requests.where(c("route") == D.FUSED).select("request_id", "scope", F.array_distinct(tokens(c("question"))).alias("q"))
    n = F.size(F.array_intersect("w", "q"))
    met = asked.join(chunks, "scope").select("request_id", "chunk_id", n.alias("n"), F.round(n / F.size("w"), 6).alias("share")).where("n > 0")
    ranked = lambda score: top_k(met, 1000, "request_id", "chunk_id", score).select("request_id", "chunk_id", "rank")  # noqa: E731  scopes have few chunks
    beside = requests.join(chunks.where(c("at") % 4 == 3), "scope").select("request_id", "chunk_id", (-c("chunk_id")).alias("s"))
    graph = top_k(beside, 1000, "request_id", "chunk_id", "s").select("request_id", "chunk_id", "rank")
    return D.contexts(requests, chunks.drop("w"), [ranked("n"), ranked("share")], graph, 3, 4, 1)
