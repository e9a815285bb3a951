"""The fetch queue and the host rate limiter as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

QUEUE_OUT = "job_id string, url string, status string, attempts int, next_retry_s double"
RATE_OUT = "domain string, requests bigint, too_soon bigint, last_at double"


class QueueState(StatefulProcessor):
    """State of one (job_id, url): attempts and status; an event is a fetch that ended (ok, blocked, retry_after)."""

    def __init__(self, most: int = 5):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "attempts int, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts, status = self.state.get() if self.state.exists() else (0, "queued")
        wait = None
        for pdf in rows:
            for e in pdf.sort_values("seq").itertuples():
                if status in ("done", "failed", "skipped"):
                    continue
                attempts += 1
                if e.ok:
                    status, wait = "done", None
                elif e.blocked:
                    status, wait = "skipped", None
                else:
                    status = "failed" if attempts >= self.most else "queued"
                    asked = None if pd.isna(e.retry_after) else float(e.retry_after)
                    wait = None if status == "failed" else (asked if asked is not None else min(2.0**attempts, 3600.0))
        self.state.update((attempts, status))
        yield pd.DataFrame({"job_id": [key[0]], "url": [key[1]], "status": [status], "attempts": [attempts], "next_retry_s": [wait]})

    def close(self) -> None:
        pass


class HostRate(StatefulProcessor):
    """State of one host: when it was last asked, and how often too soon."""

    def __init__(self, delay: float = 1.0):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rate", "n bigint, soon bigint, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, soon, last = self.state.get() if self.state.exists() else (0, 0, None)
        for pdf in rows:
            for at in sorted(pdf["at"]):
                n, soon = n + 1, soon + (last is not None and at - last < self.delay)
                last = at if last is None else max(at, last)
        self.state.update((n, soon, last))
        yield pd.DataFrame({"domain": [key[0]], "requests": [n], "too_soon": [int(soon)], "last_at": [last]})

    def close(self) -> None:
        pass


def track_queue(events: DataFrame, most: int = 5) -> DataFrame:
    """Latest state of each (job_id, url) after every batch of events (seq, ok, blocked, retry_after)."""
    return events.groupBy("job_id", "url").transformWithStateInPandas(QueueState(most), QUEUE_OUT, "Update", "None")


def track_hosts(requests: DataFrame, delay: float = 1.0) -> DataFrame:
    """Running counts per host of requests (domain, at in seconds)."""
    return requests.groupBy("domain").transformWithStateInPandas(HostRate(delay), RATE_OUT, "Update", "None")


def hourly(events: DataFrame, time: str = "fetched_at", late: str = "1 hour") -> DataFrame:
    """Tumbling hourly counts with a watermark; rows later than ``late`` are left out by design."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 hour"), "job_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "job_id", "n")
