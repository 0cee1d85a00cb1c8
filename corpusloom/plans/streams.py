"""The streams over the driver's events, run over all that there is, with DuckDB SQL for the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.streaming.chat import assistant_turns
from corpusloom.streaming.jobs import job_outcomes
from corpusloom.streaming.sink import run_available, stream_of
from corpusloom.streaming.snapshots import changed_snapshots

CHAT = """c AS (SELECT user_id AS conversation_id, user_id * 1000 + event_id // 400 AS message_id, event_id AS seq,
  CASE WHEN value > 97 THEN 'end' WHEN event_type = 'purchase' AND value > 70 THEN 'done' WHEN event_type = 'error' AND value > 90 THEN 'error'
       WHEN event_type = 'signup' THEN 'sources' WHEN event_type = 'error' THEN 'artifact' ELSE 'chunk' END AS event,
  json_extract_string(props, '$.k') AS k, value FROM events)"""


@query(f"""WITH {CHAT}, f AS (SELECT message_id, arg_min(event, seq) AS closed_by, min(seq) AS ended, arg_min(k, seq) AS k, arg_min(value, seq) AS value FROM c
  WHERE event IN ('done', 'end', 'error') GROUP BY ALL),
g AS (SELECT message_id, min(conversation_id) AS conversation_id, string_agg('t' || c.k || ' ', '' ORDER BY seq) FILTER (event = 'chunk') AS said, count(*) FILTER (event = 'chunk') AS n_chunks,
  arg_max(c.k, seq) FILTER (event = 'sources') AS s, string_agg('{{"id":' || c.k || '}}', ',' ORDER BY seq) FILTER (event = 'artifact') AS a
  FROM c JOIN f USING (message_id) WHERE seq <= ended GROUP BY message_id)
SELECT conversation_id, message_id, CASE WHEN closed_by = 'done' AND f.value > 85 THEN 'whole ' || f.k ELSE coalesce(said, '') END AS response,
  CASE WHEN closed_by = 'done' AND f.value > 85 THEN '[]' WHEN s IS NULL THEN '[]' ELSE '[{{"chunk_id":"c' || s || '"}}]' END AS sources, '[' || coalesce(a, '') || ']' AS artifacts,
  n_chunks, closed_by FROM f JOIN g USING (message_id) WHERE closed_by <> 'error'""")
def chat_turns(spark, sf):
    e = stream_of(spark, sf, "events")
    kind, value, k = F.col("event_type"), F.col("value"), F.get_json_object("props", "$.k")
    event = (
        F.when(value > 97, "end").when((kind == "purchase") & (value > 70), "done").when((kind == "error") & (value > 90), "error")
        .when(kind == "signup", "sources").when(kind == "error", "artifact").otherwise("chunk")
    )
    said = F.when(value > 85, F.concat(F.lit('{"response":"whole '), k, F.lit('","sources":[]}'))).otherwise(F.lit("{}"))
    shapes = {
        "chunk": F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"t'), k, F.lit(' "'))).otherwise(F.concat(F.lit('{"delta":"t'), k, F.lit(' "}'))),
        "sources": F.concat(F.lit('["x",{"chunk_id":"c'), k, F.lit('"}]')), "artifact": F.concat(F.lit('{"id":'), k, F.lit("}")), "done": said,
    }
    data = F.lit(None).cast("string")
    for name, shape in shapes.items():
        data = F.when(event == name, shape).otherwise(data)
    message = F.col("user_id") * 1000 + F.floor(F.col("event_id") / 400)
    rows = e.select(F.col("user_id").alias("conversation_id"), message.alias("message_id"), F.col("event_id").alias("seq"), event.alias("event"), data.alias("data"))
    return run_available(assistant_turns(rows), "turns")


@query("""WITH j AS (SELECT user_id AS conversation_id, event_id AS seq, CASE WHEN value < 50 THEN 'queue' ELSE 'run' END AS kind,
  CASE WHEN event_type = 'view' THEN NULL ELSE 'g' || (event_id // 1000 + CAST(json_extract(props, '$.k') AS INT) % 2) END AS generation FROM events),
n AS (SELECT *, 'build:' || conversation_id || ':' || coalesce(generation, 'manual') AS job_id,
  kind = 'queue' AND row_number() OVER (PARTITION BY conversation_id, generation, kind ORDER BY seq) = 1 AS first_queue FROM j),
k AS (SELECT *, last_value(CASE WHEN first_queue THEN generation END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY seq) AS current FROM n),
r AS (SELECT *, kind = 'run' AND NOT coalesce(generation <> current, false) AS fits FROM k),
b AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, job_id, fits ORDER BY seq) AS nth FROM r)
SELECT conversation_id, seq, job_id, CASE WHEN kind = 'queue' THEN CASE WHEN first_queue THEN 'queued' ELSE 'duplicate' END WHEN NOT fits THEN 'stale'
  WHEN nth > 1 THEN 'duplicate' ELSE 'built' END AS outcome FROM b""")
def job_queue(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    generation = F.concat(F.lit("g"), (F.floor(F.col("event_id") / 1000) + k % 2).cast("string"))
    rows = stream_of(spark, sf, "events").select(
        F.col("user_id").alias("conversation_id"), F.col("event_id").alias("seq"), F.when(F.col("value") < 50, "queue").otherwise("run").alias("kind"),
        F.when(F.col("event_type") == "view", F.lit(None)).otherwise(generation).alias("generation"),
    )
    return run_available(job_outcomes(rows), "jobs")


@query("""WITH s AS (SELECT user_id AS conversation_id, event_id AS seq, CAST(user_id % 3 AS VARCHAR) AS course_id,
  CASE WHEN value > 96 THEN CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ready' END WHEN value > 50 THEN 'validating' ELSE 'queued' END AS status,
  CAST(event_id // 2000 AS VARCHAR) AS generation, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS event_id FROM events),
e AS (SELECT conversation_id, min(seq) AS ended FROM s WHERE status IN ('ready', 'failed') GROUP BY ALL),
l AS (SELECT s.*, lag(ROW(course_id, status, generation, event_id)) OVER (PARTITION BY s.conversation_id ORDER BY seq) AS before FROM s LEFT JOIN e USING (conversation_id)
  WHERE seq <= coalesce(ended, seq))
SELECT conversation_id, seq, course_id, status, generation, event_id FROM l WHERE before IS DISTINCT FROM ROW(course_id, status, generation, event_id)""")
def course_snapshots(spark, sf):
    value, kind = F.col("value"), F.col("event_type")
    status = F.when(value > 96, F.when(kind == "error", "failed").otherwise("ready")).when(value > 50, "validating").otherwise("queued")
    rows = stream_of(spark, sf, "events").select(
        F.col("user_id").alias("conversation_id"), F.col("event_id").alias("seq"), (F.col("user_id") % 3).alias("course_id"), status.alias("status"),
        F.floor(F.col("event_id") / 2000).alias("generation"), F.when(kind != "view", kind).alias("event"),
    ).withColumnRenamed("event", "event_id")
    return run_available(changed_snapshots(rows), "snapshots")
