"""The job lifecycle as a stream: keyed state, timeouts by processing time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..config import DEFAULTS, FAILED, PROCESSING, TERMINAL

OUT = "job_id string, status string, started_at timestamp, completed_at timestamp"
STATE = "status string, started_at timestamp, completed_at timestamp"


def job_states(events: DataFrame, minutes: int = DEFAULTS.job_timeout_minutes, days: float = DEFAULTS.job_retention_days) -> DataFrame:
    """Updates of each job's state from events (job_id, event_id, status, ts).

    An update of an unknown job is left out, a start of a known id begins its job anew, a later terminal event
    replaces an earlier one. A job that stays in PROCESSING fails once the timeout passes; its state is kept for the
    retention, so that a late completion still wins, and then goes, as does that of every job without events
    for so long after its end. So what is kept follows the jobs of the retention, not all jobs ever seen (0 days: all).
    """

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        row = lambda s: pd.DataFrame({"job_id": [key[0]], "status": [s[0]], "started_at": [s[1]], "completed_at": [s[2]]})
        if state.hasTimedOut:
            s = list(state.get)
            if s[0] == PROCESSING:
                now = pd.Timestamp(state.getCurrentProcessingTimeMs(), unit="ms")
                s = [FAILED, s[1], now]
                state.update(tuple(s))
                if days > 0:
                    state.setTimeoutDuration(int(days * 86_400_000))
                yield row(s)
            else:
                state.remove()
            return
        s = list(state.get) if state.exists else None
        got = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for status, ts in zip(got["status"], got["ts"], strict=True):
            if status == PROCESSING:
                s = [PROCESSING, ts, None]
            elif s is not None and status in TERMINAL:
                s = [status, s[1], ts]
        if s is not None:
            state.update(tuple(s))
            if s[0] == PROCESSING and minutes > 0:
                state.setTimeoutDuration(minutes * 60_000)
            elif s[0] != PROCESSING and days > 0:
                state.setTimeoutDuration(int(days * 86_400_000))
            yield row(s)

    return events.groupBy("job_id").applyInPandasWithState(fold, OUT, STATE, "update", "ProcessingTimeTimeout")
