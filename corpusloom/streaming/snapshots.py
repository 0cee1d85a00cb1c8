"""Snapshots of courses that are sent only when something has changed, until they are ready or failed.

Snapshots are (conversation_id, seq, course_id, status, generation, event_id). What is compared is the last four, nulls as empty; the stream of a
conversation ends with its first snapshot that is ready or failed.

Defined results: snapshots are taken in order of seq within a batch; one with a seq that was taken before goes; rows without a conversation or
seq go.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.streaming.sink import stateful

OUTPUT = "conversation_id bigint, seq bigint, course_id string, status string, generation string, event_id string"
CURSOR = ("course_id", "status", "generation", "event_id")
FINAL = ("ready", "failed")


class Snapshots(StatefulProcessor):
    """State of a conversation: last seq, last cursor, and whether it has ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "last bigint, ended boolean, " + ", ".join(f"{c} string" for c in CURSOR))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = tuple(self.seen.get()) if self.seen.exists() else (None, False, None, None, None, None)
        last, ended, cursor = state[0], state[1], state[2:]
        for r in [] if ended else sorted(rows, key=lambda r: (r["seq"], *(r[c] for c in CURSOR))):
            if last is not None and r["seq"] <= last:
                continue
            last, now = r["seq"], tuple(r[c] for c in CURSOR)
            if now != cursor:
                cursor = now
                yield Row(conversation_id=key[0], seq=last, **dict(zip(CURSOR, now)))
            if r["status"] in FINAL:
                ended = True
                break
        if last is not None:
            self.seen.update((last, ended, *cursor))

    def close(self) -> None:
        pass


def changed_snapshots(snapshots: DataFrame) -> DataFrame:
    """The snapshots of a stream that differ from the one before."""
    stateful(snapshots.sparkSession)
    rows = snapshots.select(
        F.col("conversation_id").cast("bigint").alias("conversation_id"), F.col("seq").cast("bigint").alias("seq"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CURSOR],
    ).where("conversation_id IS NOT NULL AND seq IS NOT NULL")
    return rows.groupBy("conversation_id").transformWithState(Snapshots(), OUTPUT, "update", "None")
