"""The sweeper as a stream: jobs whose heartbeat stops are reported once their silence is long enough.

State per job is its last heartbeat and status; an event-time timeout fires where a
running job was silent past the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STALE_SECONDS = 300
OUTPUT = "job_id string, last_heartbeat timestamp, action string"
STATE = "status string, last_ms long"


def _sweep(seconds: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, last_ms = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "last_heartbeat": [pd.Timestamp(last_ms, unit="ms")], "action": ["requeue"]})
            return
        status, last_ms = state.get if state.exists else ("pending", 0)
        for batch in batches:
            for at, new in sorted(zip(batch["heartbeat_at"], batch["status"], strict=True)):
                at_ms = int(at.timestamp() * 1000)
                if at_ms >= last_ms:
                    status, last_ms = new, at_ms
        if status != "running":
            state.remove() if state.exists else None
            return
        state.update((status, last_ms))
        state.setTimeoutTimestamp(max(last_ms + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return run


def stale_jobs(events: DataFrame, seconds: int = STALE_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """From a stream ``(job_id, heartbeat_at, status)`` the running jobs that went silent: ``job_id, last_heartbeat, action``."""
    keyed = events.withWatermark("heartbeat_at", delay).groupBy("job_id")
    return keyed.applyInPandasWithState(_sweep(seconds), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
