"""A queue of build jobs without repetitions and without stale generations.

Events are (conversation_id, seq, kind, generation). `queue` asks for a build: its job is known by conversation and generation, `manual` without one,
and one that was queued before isn't queued again. A newly queued generation is the conversation's current one. `run` is a worker that takes a
job up: it builds, unless its generation is no longer current, or the job has been built. A job without a generation is never stale.

Defined results: events are taken in order of seq within a batch; one with a seq that was taken before is a repetition and gives nothing; rows
without a conversation, seq or kind go; a run of a job that nobody queued builds, and such a job can still be queued once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.streaming.sink import stateful

OUTPUT = "conversation_id bigint, seq bigint, job_id string, outcome string"


class Jobs(StatefulProcessor):
    """State of a conversation: last seq and current generation, and the jobs it has seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "last bigint, generation string")
        self.jobs = handle.getMapState("jobs", "job_id string", "queued boolean, built boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, current = self.current.get() if self.current.exists() else (None, None)
        for r in sorted(rows, key=lambda r: (r["seq"], r["kind"], r["generation"] or "")):
            if last is not None and r["seq"] <= last:
                continue
            last, generation = r["seq"], r["generation"]
            job = (f"build:{key[0]}:{generation or 'manual'}",)
            queued, built = self.jobs.getValue(job) if self.jobs.containsKey(job) else (False, False)
            if r["kind"] == "queue":
                outcome = "duplicate" if queued else "queued"
                if not queued:
                    self.jobs.updateValue(job, (True, built))
                    current = generation or current
            elif generation and current is not None and generation != current:
                outcome = "stale"
            elif built:
                outcome = "duplicate"
            else:
                outcome = "built"
                self.jobs.updateValue(job, (queued, True))
            yield Row(conversation_id=key[0], seq=last, job_id=job[0], outcome=outcome)
        if last is not None:
            self.current.update((last, current))

    def close(self) -> None:
        pass


def job_outcomes(events: DataFrame) -> DataFrame:
    """(conversation_id, seq, job_id, outcome) for every event of a stream: queued, duplicate, built or stale."""
    stateful(events.sparkSession)
    rows = events.select(F.col("conversation_id").cast("bigint").alias("conversation_id"), F.col("seq").cast("bigint").alias("seq"), "kind", "generation")
    rows = rows.where("conversation_id IS NOT NULL AND seq IS NOT NULL AND kind IN ('queue', 'run')")
    return rows.groupBy("conversation_id").transformWithState(Jobs(), OUTPUT, "update", "None")
