"""The ordered folds as streams: state for each learner and concept, kept by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.session import ship

OUTPUT = "learner bigint, concept string, seq bigint, mastery double, n_events bigint"


def _step(mastery: float, score: float, applied: bool) -> float:
    if score >= 0.85:
        mastery += (0.25 if applied else 0.16) * (1 - mastery)
    elif score >= 0.6:
        mastery += 0.10 * (1 - mastery)
    else:
        mastery *= 0.75 if score >= 0.25 else 0.60
    return min(1.0, max(0.0, mastery))


def fold_assessments_stream(events: DataFrame) -> DataFrame:
    """Mastery after every batch for the pairs that it touches, from a stream (learner, concept, seq, score, applied).

    Events of one batch are folded in order of seq; one that arrives with a seq not above the last is late and dropped.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mastery, last, n = state.get if state.exists else (0.0, -1, 0)
        batch = pd.concat(list(frames)).sort_values("seq")
        for row in batch[batch.seq > last].drop_duplicates("seq").itertuples():
            mastery, last, n = _step(mastery, float(row.score), bool(row.applied)), int(row.seq), n + 1
        state.update((mastery, last, n))
        yield pd.DataFrame([(key[0], key[1], last, mastery, n)], columns=["learner", "concept", "seq", "mastery", "n_events"])

    ship(events.sparkSession)
    return events.groupBy("learner", "concept").applyInPandasWithState(
        update, OUTPUT, "mastery double, last bigint, n bigint", "update", GroupStateTimeout.NoTimeout
    )
