"""The fetch queue as data: what is due, what to retry, and what rates allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import retry_seconds


def due(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Enabled jobs that may start, most urgent first: never planned or planned up to now."""
    ready = F.col("enabled") & F.col("status").isin("idle", "completed", "failed", "continuing") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= as_of))
    return jobs.where(ready).orderBy(F.desc("priority"), F.asc_nulls_first("next_run_at"), "job_id")


def claim(queue: DataFrame, as_of: Column, per_job: int, ready: DataFrame | None = None) -> DataFrame:
    """Each job's next ``per_job`` queued links by priority; with ``ready`` (domain), only of hosts that may be asked."""
    rows = queue.where((F.col("status") == "queued") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of)))
    if ready is not None:
        rows = rows.join(ready.select("domain").distinct(), "domain", "left_semi")
    w = Window.partitionBy("job_id").orderBy(F.desc("priority"), "queue_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_job)


def after_fetch(queue: DataFrame) -> DataFrame:
    """Next state of claimed rows with (``ok``, ``blocked``, ``retry_after``, ``now``): done, skipped, queued again or failed."""
    tries = F.col("attempt_count") + 1
    state = F.when(F.col("ok"), "done").when(F.col("blocked"), "skipped").when(tries >= F.col("max_attempts"), "failed").otherwise("queued")
    wait = F.timestamp_micros(F.unix_micros(F.col("now").cast("timestamp")) + (retry_seconds(tries, F.col("retry_after")) * 1_000_000).cast("bigint"))
    return queue.withColumns({"attempt_count": tries, "status": state, "next_retry_at": F.when(state == "queued", wait)})


def stale(queue: DataFrame, as_of: Column, days: int, most: int = 500) -> DataFrame:
    """The ``most`` rows fetched longest ago, beyond ``days``; never fetched ones first."""
    cutoff = as_of - F.expr(f"interval {days} days")
    return queue.where(F.col("fetched_at").isNull() | (F.col("fetched_at") <= cutoff)).orderBy(F.asc_nulls_first("fetched_at"), "fetch_id").limit(most)


def gaps(fetches: DataFrame, host: Column, delay: Column) -> DataFrame:
    """Adds seconds since the host's previous request and whether that was too soon."""
    w = Window.partitionBy("domain").orderBy("fetched_at", "fetch_id")
    out = fetches.withColumn("domain", host).withColumn("gap", (F.unix_micros(F.col("fetched_at").cast("timestamp")) - F.unix_micros(F.lag("fetched_at").over(w).cast("timestamp"))) / 1e6)
    return out.withColumn("too_soon", F.coalesce(F.col("gap") < delay, F.lit(False)))


def schedule(queue: DataFrame, delay: float) -> DataFrame:
    """Adds ``starts_after``: seconds until each row's turn if every host is asked once per ``delay``."""
    w = Window.partitionBy("domain").orderBy(F.desc("priority"), "queue_id")
    return queue.withColumn("starts_after", (F.row_number().over(w) - 1) * F.lit(delay))
