"""Streams with state over several batches, restarts and replays, by hand and against SQL."""

import json
import os
import time

import duckdb
import pytest

from corpusloom.plans import registry, streams  # noqa: F401
from corpusloom.streaming import sink
from corpusloom.streaming.chat import assistant_turns
from corpusloom.streaming.jobs import job_outcomes
from corpusloom.streaming.snapshots import changed_snapshots

CHAT = "conversation_id bigint, message_id bigint, seq bigint, event string, data string"


def files(spark, folder, schema, *batches):
    """One file for each batch, oldest first."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part{k}")
        (made,) = [f for f in os.listdir(f"{folder}/part{k}") if f.endswith(".parquet")]
        os.makedirs(f"{folder}/in.parquet", exist_ok=True)
        os.rename(f"{folder}/part{k}/{made}", f"{folder}/in.parquet/{k}.parquet")
        os.utime(f"{folder}/in.parquet/{k}.parquet", (time.time() - 100 + k,) * 2)
    return sink.stream_of(spark, str(folder), "in")


def test_turns_over_batches(spark, tmp_path):
    first = [(1, 10, 2, "chunk", '{"delta": "b"}'), (1, 10, 1, "chunk", '"a"'), (1, 11, 3, "chunk", "no json"), (1, None, 4, "chunk", '"x"'), (1, 12, 5, "chunk", '"lost"'), (2, 13, 6, "chunk", '"idle"')]
    second = [(1, 10, 2, "chunk", '"again"'), (1, 10, 7, "sources", '[{"id": 1}, 2]'), (1, 10, 8, "artifact", '{"k": "v"}'), (1, 12, 9, "error", None), (1, 12, 10, "done", "{}"), (1, 11, 11, "end", None)]
    third = [(1, 10, 12, "done", '{"response": "", "artifacts": [7]}'), (1, 10, 13, "done", '{"response": "late"}'), (1, 14, 14, "done", '{"response": "whole", "sources": []}'), (1, 15, 15, "done", "broken")]
    got = {r.message_id: r for r in sink.run_available(assistant_turns(files(spark, tmp_path, CHAT, first, second, third)), "t").collect()}
    assert set(got) == {10, 11, 14}
    assert (got[10].response, json.loads(got[10].sources), json.loads(got[10].artifacts), got[10].n_chunks, got[10].closed_by) == ("ab", [{"id": 1}], [7], 2, "done")
    assert (got[11].response, got[11].closed_by) == ("", "end") and got[14].response == "whole"


def test_silent_messages_close(spark, tmp_path):
    stream = files(spark, tmp_path, CHAT, [(1, 1, 1, "chunk", '"half"')], [(1, 2, 2, "end", None)], [(1, 1, 3, "done", "{}")])
    q = assistant_turns(stream, idle_ms=1).writeStream.format("memory").queryName("idle").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    until = time.time() + 60  # a stream with such timers goes on until it is stopped
    while time.time() < until and spark.table("idle").count() < 2:
        time.sleep(1)
    q.stop()
    got = {r.message_id: r for r in spark.table("idle").collect()}
    assert (got[1].response, got[1].closed_by) == ("half", "idle") and got[2].closed_by == "end"


def test_jobs(spark, tmp_path):
    rows = [
        [(1, 1, "queue", "g1"), (1, 2, "queue", "g1"), (1, 3, "queue", "g2"), (1, 4, "run", "g1")],
        [(1, 4, "run", "g2"), (1, 5, "run", "g2"), (1, 6, "run", "g2"), (1, 7, "run", None), (1, 8, "run", None), (2, 9, "run", "g9"), (2, 10, "queue", "g9"), (None, 1, "run", "g"), (3, None, "run", "g"), (3, 1, "stop", "g")],
    ]
    got = sink.run_available(job_outcomes(files(spark, tmp_path, "conversation_id bigint, seq bigint, kind string, generation string", *rows)), "j").collect()
    assert {(r.conversation_id, r.seq): r.outcome for r in got} == {
        (1, 1): "queued", (1, 2): "duplicate", (1, 3): "queued", (1, 4): "stale", (1, 5): "built", (1, 6): "duplicate", (1, 7): "built", (1, 8): "duplicate",
        (2, 9): "built", (2, 10): "queued",
    }


def test_snapshots_end(spark, tmp_path):
    row = lambda seq, status, event=None, conv=1: (conv, seq, "c", status, "g", event)
    schema = "conversation_id bigint, seq bigint, course_id string, status string, generation string, event_id string"
    batches = [row(1, "queued"), row(2, "queued"), row(3, "queued", "e")], [row(3, "late"), row(4, "queued", "e"), row(5, "ready", "e"), row(6, "queued", "e")], [row(7, "queued")]
    got = sink.run_available(changed_snapshots(files(spark, tmp_path, schema, *batches)), "s").collect()
    assert sorted((r.seq, r.status) for r in got) == [(1, "queued"), (3, "queued"), (5, "ready")]


def test_replays_and_restarts_write_once(spark, tmp_path):
    path, rows = str(tmp_path / "out"), spark.createDataFrame([(1,), (2,)], "x int")
    for _ in range(2):
        sink.write_batch(path)(rows, 0)
    sink.write_batch(path)(rows, 1)
    assert spark.read.parquet(f"{path}/batch=*").count() == 4
    stream = files(spark, tmp_path, CHAT, [(1, 1, 1, "chunk", '"a"')], [(1, 1, 2, "done", "{}")])
    for _ in range(2):  # the second run goes on from the first one's state and finds nothing new
        q = assistant_turns(stream).writeStream.foreachBatch(sink.write_batch(f"{path}2")).outputMode("update").trigger(availableNow=True)
        q.option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    assert [r.response for r in spark.read.parquet(f"{path}2/batch=*").collect()] == ["a"]


@pytest.mark.parametrize(("name", "column"), [("chat_turns", "closed_by"), ("job_queue", "outcome"), ("course_snapshots", "status")])
def test_every_branch_occurs(name, column):
    duckdb.sql("CREATE OR REPLACE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    kinds = {"chat_turns": {"done", "end"}, "job_queue": {"queued", "duplicate", "built", "stale"}, "course_snapshots": {"queued", "validating", "ready", "failed"}}
    assert {x for (x,) in duckdb.sql(f"SELECT DISTINCT {column} FROM ({registry.SQL[name]})").fetchall()} == kinds[name]
