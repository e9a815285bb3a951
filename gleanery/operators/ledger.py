"""Run history, reviews, counters, rates and queue transitions: append-only events, and the state they fold to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalize_url

RUN_COUNTS = ["discovered_count", "fetched_count", "inserted_count", "updated_count", "duplicate_count", "review_count", "error_count"]
#: Counters a day has; others are ignored.
DAY_COUNTERS = ["discovered", "fetched", "extracted", "new_entities", "updated_entities", "duplicates", "reviews", "fetch_errors"]


def _seconds(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def run_history(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """Runs (run_id, job_id, started_at) with the first of their finishes (run_id, at, seq, status, any of RUN_COUNTS).

    A run is finished once: later finishes, and those of unknown runs, change
    nothing. A run without a finish is running and has no duration.
    """
    counts = [c for c in RUN_COUNTS if c in finishes.columns]
    first = finishes.groupBy("run_id").agg(F.min_by(F.struct("status", "at", *counts), F.struct("at", "seq")).alias("f"))
    rows = starts.join(first, "run_id", "left")
    return rows.select("run_id", "job_id", "started_at", F.coalesce("f.status", F.lit("running")).alias("status"), F.col("f.at").alias("finished_at"), _seconds(F.col("started_at"), F.col("f.at")).alias("duration_seconds"), *(F.coalesce(f"f.{c}", F.lit(0)).alias(c) for c in counts))


def unfinished(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, run_ids, n): what did not complete, ids in order."""
    return runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("status") != "completed", F.col("run_id")))).alias("run_ids"), F.count_if(F.col("status") != "completed").alias("n"))


def growth(rows: DataFrame, key: str, at: str, start: Column, end: Column) -> DataFrame:
    """(key, before, after, delta): rows that exist at two times."""
    one = rows.groupBy(key).agg(F.count_if(F.col(at) < start).alias("before"), F.count_if(F.col(at) < end).alias("after"))
    return one.withColumn("delta", F.col("after") - F.col("before"))


def counter_totals(deltas: DataFrame, allowed: list[str] = DAY_COUNTERS) -> DataFrame:
    """Sums of (day, counter, by) as one column for each counter allowed; unknown counters are ignored."""
    return deltas.groupBy("day").agg(*(F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("by"))), F.lit(0)).alias(c) for c in allowed))


def missing_seeds(jobs: DataFrame, queue: DataFrame) -> DataFrame:
    """(job_id, url): links of ``seed_urls`` in a job's config that are not queued; blank ones are skipped."""
    seeds = jobs.select("job_id", F.explode(F.from_json(F.get_json_object("config_json", "$.seed_urls"), "array<string>")).alias("url"))
    seeds = seeds.select("job_id", normalize_url("url").alias("url")).where("url != ''").distinct()
    return seeds.join(queue.select("job_id", "url"), ["job_id", "url"], "left_anti")


def with_status(rows: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Rows with the status and time of the last of their events (key, at, seq, status); others keep theirs."""
    last = events.groupBy(key).agg(F.max_by(F.struct("status", "at"), F.struct("at", "seq")).alias("_e"))
    return rows.join(last, key, "left").withColumns({"status": F.coalesce("_e.status", "status"), "reviewed_at": F.coalesce("_e.at", "reviewed_at")}).drop("_e")


def reviews(added: DataFrame, closed: DataFrame) -> DataFrame:
    """Reviews (review_id, reason, created_at, ...) with status open, or that of the first of their closings (review_id, at, seq, status)."""
    first = closed.groupBy("review_id").agg(F.min_by(F.struct("status", "at"), F.struct("at", "seq")).alias("c"))
    return added.join(first, "review_id", "left").select(added["*"], F.coalesce("c.status", F.lit("open")).alias("status"), F.col("c.at").alias("closed_at"))


def rate_state(events: DataFrame, as_of: Column, delay: Column, seconds_blocked: str = "block_seconds") -> DataFrame:
    """(domain, last_request_at, error_count, blocked_until, ready, wait_s) from (domain, at, seq, kind, block_seconds).

    Every event is a request; kind is error or success. A success clears errors
    and the block; the block of the last error with one counts from its time.
    """
    order = F.struct("at", "seq")
    sums = events.groupBy("domain").agg(F.max("at").alias("last_request_at"), F.max(F.when(F.col("kind") == "success", order)).alias("ok"))
    errors = events.where("kind = 'error'").join(sums.select("domain", "ok"), "domain").where(F.col("ok").isNull() | (order > F.col("ok")))
    until = F.timestamp_micros(F.unix_micros(F.col("at").cast("timestamp")) + (F.col(seconds_blocked) * 1_000_000).cast("bigint")).cast("timestamp_ntz")
    last = errors.groupBy("domain").agg(F.count("*").alias("error_count"), F.max_by(F.when(F.col(seconds_blocked) > 0, until), F.when(F.col(seconds_blocked) > 0, order)).alias("blocked_until"))
    rows = sums.join(last, "domain", "left").select("domain", "last_request_at", F.coalesce("error_count", F.lit(0)).alias("error_count"), "blocked_until")
    wait = F.when(as_of < F.col("blocked_until"), _seconds(as_of, F.col("blocked_until"))).otherwise(F.greatest(F.lit(0.0), delay - _seconds(F.col("last_request_at"), as_of)))
    return rows.withColumn("wait_s", wait).withColumn("ready", F.col("wait_s") <= 0)


def readiness(state: DataFrame) -> DataFrame:
    """One row: the shortest wait of domains that are not ready, and how many are."""
    return state.agg(F.min(F.when(~F.col("ready"), F.col("wait_s"))).alias("least_wait_s"), F.count_if("ready").alias("n_ready"))


def ready_domains(state: DataFrame) -> DataFrame:
    return state.where("ready").select("domain")


# ---- transitions of queue and jobs ----


def requeued(queue: DataFrame, as_of: Column, seconds: float) -> DataFrame:
    """Rows stuck in ``fetching`` since more than ``seconds`` go back to the queue."""
    stuck = (F.col("status") == "fetching") & (_seconds(F.col("claimed_at"), as_of) > seconds)
    return queue.withColumns({"status": F.when(stuck, "queued").otherwise(F.col("status")), "claimed_at": F.when(~F.coalesce(stuck, F.lit(False)), F.col("claimed_at"))})


def revalidated(queue: DataFrame, as_of: Column, seconds: float, key: str, most: int = 500) -> DataFrame:
    """The ``most`` rows done longest ago, over ``seconds``, queued again with no attempts; etag and last_modified stay."""
    old = queue.where((F.col("status") == "done") & (_seconds(F.col("fetched_at"), as_of) > seconds))
    return old.orderBy("fetched_at", key).limit(most).withColumns({"status": F.lit("queued"), "attempt_count": F.lit(0)})


def fetch_routes(fetches: DataFrame) -> DataFrame:
    """Adds ``queue_status``, ``review_reason``, ``errors``, ``reviews`` and ``extract`` to fetches (ok, blocked, http_status, error, attempts, max_attempts)."""
    dead = F.col("attempts") >= F.col("max_attempts")
    state = F.when(F.col("blocked"), "skipped").when(F.col("http_status") == 304, "done").when(F.col("ok"), "done").when(dead, "failed").otherwise("queued")
    reason = F.when(F.col("blocked"), F.when(F.lower(F.coalesce("error", F.lit(""))).contains("captcha"), "captcha").otherwise("blocked")).when(state == "failed", "parse_failure")
    rows = fetches.withColumns({"queue_status": state, "review_reason": reason})
    return rows.withColumns({"errors": (F.col("blocked") | ~F.col("queue_status").isin("done")).cast("int"), "reviews": F.col("review_reason").isNotNull().cast("int"), "extract": (F.col("queue_status") == "done") & ~F.coalesce(F.col("http_status") == 304, F.lit(False))})


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every value given; None asks for nothing."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def moved(rows: DataFrame, allowed: list[str], to: str, also: Column | None = None) -> DataFrame:
    """Guarded transition: rows in an ``allowed`` status (for which ``also`` holds) go to ``to``; ``changed`` tells which."""
    may = F.col("status").isin(*allowed) & (also if also is not None else F.lit(True))
    return rows.withColumn("changed", F.coalesce(may, F.lit(False))).withColumn("status", F.when(F.col("changed"), to).otherwise(F.col("status")))


def stale_jobs(jobs: DataFrame, as_of: Column, seconds: float = 300.0) -> DataFrame:
    """Running jobs that started more than ``seconds`` ago."""
    return jobs.where((F.col("status") == "running") & (_seconds(F.col("last_started_at"), as_of) > seconds))


def after_run(jobs: DataFrame, queue: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds ``next_status``: continuing while links are queued or candidates are new, else completed."""
    left = queue.where("status = 'queued'").select("job_id").unionByName(candidates.where("status = 'new'").select("job_id")).distinct().withColumn("_more", F.lit(True))
    return jobs.join(left, "job_id", "left").withColumn("next_status", F.when(F.col("_more"), "continuing").otherwise("completed")).drop("_more")


def page(rows: DataFrame, order: list, most: int, offset: int = 0) -> DataFrame:
    """``most`` rows of a total order after the first ``offset``."""
    return rows.orderBy(*order).offset(offset).limit(most)


def first_contained(rows: DataFrame, text: str, names: list[str], out: str) -> DataFrame:
    """Adds the first of ``names``, in their order, that a text contains."""
    return rows.withColumn(out, F.coalesce(*(F.when(F.contains(F.col(text), F.lit(n)), F.lit(n)) for n in names)))
