"""Answers that arrive as events, kept once for each message when it is done.

Events are (conversation_id, message_id, seq, event, data), data being JSON: `chunk` adds text, `sources` sets the sources, `artifact` adds one,
`done` closes the message with what it says itself or else with what was collected, `end` closes one whose connection ended without that,
and `error` drops it. Nothing after the first of these counts. A message that stays silent is closed as by `end` where a time is given.

Defined results: events of a batch are taken in order of seq, and of two with the same seq in that of their letters; an event with a seq that
was taken before is a repetition; data that is no JSON, or has another shape, adds nothing; rows without a message or event go.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.streaming.sink import stateful

OUTPUT = "conversation_id bigint, message_id bigint, response string, sources string, artifacts string, n_chunks bigint, closed_by string"
#: Where a chunk has its text.
TEXT_KEYS = ("text", "delta", "content", "chunk")


def parsed(data: str | None) -> object:
    try:
        return json.loads(data or "null")
    except ValueError:
        return None


def text_of(data: object) -> str:
    if isinstance(data, dict):
        data = next((data[k] for k in TEXT_KEYS if isinstance(data.get(k), str)), "")
    return data if isinstance(data, str) else ""


def dumped(values: list) -> str:
    return json.dumps(values, ensure_ascii=False, separators=(",", ":"))


class Turns(StatefulProcessor):
    """State of a message: its pieces (text, or an artifact) as a list, and one value with what else is known."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "kind string, value string")
        self.known = handle.getValueState("known", "last bigint, conversation_id bigint, sources string, closed boolean, wakes bigint")

    def _turn(self, message: int, conversation: int | None, sources: str, done: dict, by: str) -> Row:
        held = list(self.pieces.get()) if self.pieces.exists() else []
        texts = [v for kind, v in held if kind == "text"]
        given = lambda key, other: dumped(done[key]) if isinstance(done.get(key), list) else other
        artifacts = dumped([json.loads(v) for kind, v in held if kind == "artifact"])
        said = done.get("response")
        return Row(conversation_id=conversation, message_id=message, response=said if isinstance(said, str) and said else "".join(texts),
                   sources=given("sources", sources), artifacts=given("artifacts", artifacts), n_chunks=len(texts), closed_by=by)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, conversation, sources, closed, wakes = self.known.get() if self.known.exists() else (None, None, "[]", False, None)
        if closed:
            return
        fresh: list[tuple[str, str]] = []
        for r in sorted(rows, key=lambda r: (r["seq"], r["event"], r["data"] or "")):
            if last is not None and r["seq"] <= last:
                continue
            last, conversation, data = r["seq"], r["conversation_id"], parsed(r["data"])
            if r["event"] == "chunk" and (text := text_of(data)):
                fresh.append(("text", text))
            elif r["event"] == "sources" and isinstance(data, list):
                sources = dumped([x for x in data if isinstance(x, dict)])
            elif r["event"] == "artifact" and isinstance(data, dict):
                fresh.append(("artifact", json.dumps(data)))
            elif r["event"] in ("done", "end", "error") and (r["event"] != "done" or isinstance(data, dict)):
                closed = True
                break
        if fresh:
            self.pieces.appendList(fresh)
        if closed:
            if r["event"] != "error":
                yield self._turn(key[0], conversation, sources, data if r["event"] == "done" else {}, r["event"])
            self.pieces.clear()
        if self.idle_ms is not None:
            if wakes is not None:
                self.handle.deleteTimer(wakes)
            wakes = None if closed else timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            if wakes is not None:
                self.handle.registerTimer(wakes)
        self.known.update((last, conversation, sources, closed, wakes))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, conversation, sources, closed, _ = self.known.get()
        if not closed:
            yield self._turn(key[0], conversation, sources, {}, "idle")
            self.pieces.clear()
            self.known.update((last, conversation, sources, True, None))

    def close(self) -> None:
        pass


def assistant_turns(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """One row for each message of a stream of events, when it is closed. With idle_ms the stream has timers, and goes on until it is stopped."""
    stateful(events.sparkSession)
    rows = events.where("message_id IS NOT NULL AND event IS NOT NULL").select(
        F.col("conversation_id").cast("bigint").alias("conversation_id"), F.col("message_id").cast("bigint").alias("message_id"),
        F.coalesce(F.col("seq").cast("bigint"), F.lit(-1)).alias("seq"), "event", "data",
    )
    return rows.groupBy("message_id").transformWithState(Turns(idle_ms), OUTPUT, "update", "None" if idle_ms is None else "ProcessingTime")
