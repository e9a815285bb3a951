"""Registered queries of the persist pipeline, the ledgers and the reports, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discover as D
from ..operators import ledger as L
from ..operators import monitor as M
from ..operators import persist as P
from ..operators import resolve as R
from ..session import table
from .queries import _DOMAIN, _FINGERPRINT, _RESOLVED, AS_OF, _as_of, query

TODAY = "2025-06-20"
_EARLIER = "2025-01-01 00:00:00"


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


# ---- persist pipeline: skip, check, normalise, resolve, store, evidence ----


def _records(spark, d):
    r = table(spark, d, "extracted_records")
    return r.drop("entity_id").withColumn("normalized_name", F.lower(F.trim("name"))), R.with_fingerprint(table(spark, d, "entities").drop("fingerprint").withColumn("normalized_name", F.lower(F.trim("name"))))


_ENTITIES = "select * replace (lower(trim(name)) as normalized_name) from entities where deleted_at is null"
_RECORDS = "select record_id as id, *, lower(trim(name)) as normalized_name from extracted_records"
_AS_RECORD = "id, job_id, normalized_name nn, domain dom, address adr, telephone tel, canonical_url u"


@query(f"with e as (select *, {_FINGERPRINT} fp from ({_ENTITIES})), c as (select {_AS_RECORD}, {_FINGERPRINT} fp from ({_RECORDS}))," + _RESOLVED + " select id as record_id, action, entity_id, reason from r")
def resolved_records(spark, d):
    rec, ent = _records(spark, d)
    return R.resolve(R.with_fingerprint(rec), ent).select("record_id", "action", "entity_id", "reason")


_BLANK = "trim(coalesce({0}, ''), E' \\t\\n\\r\\u3000\\u00a0') = ''"
_CHECKED = f"""select *, case when is_skip then 'record_marked_skip' else array_to_string(list_concat(
  list_transform(list_filter(case when list_contains(m, 'name') then list_concat(['name'], list_filter(m, lambda x: x <> 'name')) else list_concat(['name'], m) end,
    lambda r: case r when 'name' then {_BLANK.format("name")} when 'address' then {_BLANK.format("address")} when 'telephone' then {_BLANK.format("telephone")} when 'canonical_url' then {_BLANK.format("canonical_url")} else {_BLANK.format("json_extract_string(case when json_valid(fields_json) then fields_json end, '$.' || r)")} end), lambda r: 'missing_required:' || r),
  list_filter([case when fields_json is null or not json_valid(fields_json) or not starts_with(ltrim(fields_json), '{{') then 'invalid_type:fields' end, case when confidence is null then 'invalid_type:confidence' when confidence not between 0 and 1 then 'invalid_range:confidence' end,
    case when not ({_BLANK.format("canonical_url")}) and not regexp_matches(trim(canonical_url), '^(?i)https?://[^/?#]+') then 'invalid_url:canonical_url' end], lambda x: x is not null)), ',') end as errors
  from (select *, coalesce(missing_required, []) m from ({_RECORDS}))"""


@query(f"select record_id, errors, case when not is_skip and not ({_BLANK.format('canonical_url')}) and ({_BLANK.format('domain')}) then 'domain_missing_but_derivable' else '' end as warnings from ({_CHECKED})")
def record_checks(spark, d):
    r = table(spark, d, "extracted_records")
    errors, warnings = P.checks(r, ["name"])
    return r.select("record_id", F.array_join(errors, ",").alias("errors"), F.array_join(warnings, ",").alias("warnings"))


_PERSISTED = f"""with k as ({_CHECKED}), e as (select *, {_FINGERPRINT} fp from ({_ENTITIES})), c as (select {_AS_RECORD}, {_FINGERPRINT} fp from k where errors = ''),{_RESOLVED},
 p as (select k.record_id, k.job_id, k.errors, case when is_skip then 'skip' when errors <> '' then 'invalid' when r.action = 'merge' then 'updated' when r.action = 'new' then 'inserted' else r.action end as action, r.entity_id, case when is_skip then k.skip_reason when errors <> '' then errors else r.reason end as reason from k left join r on r.id = k.record_id)"""


def _persisted(spark, d):
    rec, ent = _records(spark, d)
    return P.persisted(rec, ent, ["name"])


@query(_PERSISTED + " select record_id, action, entity_id, reason from p")
def persisted(spark, d):
    return _persisted(spark, d).select("record_id", "action", "entity_id", "reason")


_ROUTED = _PERSISTED + """, t as (select *, case action when 'skip' then 'rejected' when 'invalid' then 'review' when 'inserted' then 'accepted' when 'updated' then 'duplicate' else 'review' end as candidate_status,
  case when action = 'review' then 'duplicate_ambiguity' when action = 'invalid' then case when errors like 'missing_required:%' or errors like '%,missing_required:%' then 'missing_required_field' else 'parse_failure' end end as review_reason from p)"""


@query(_ROUTED + " select record_id, candidate_status, review_reason from t")
def record_routes(spark, d):
    return P.routed(_persisted(spark, d)).select("record_id", "candidate_status", "review_reason")


@query(_ROUTED + """ select job_id, count(*) as fetched, count(*) filter (action = 'inserted') as inserted, count(*) filter (action = 'updated') as updated, count(*) filter (action = 'updated') as duplicates,
 count(*) filter (action in ('invalid', 'review')) as reviewed, count(*) filter (action = 'skip') as rejected from t group by 1""")
def action_counts(spark, d):
    return P.outcome_counts(P.routed(_persisted(spark, d)), ["job_id"])


@query(_ROUTED + " select review_reason as reason, count(*) as n from t where review_reason is not null group by 1")
def review_reasons(spark, d):
    return P.routed(_persisted(spark, d)).where("review_reason is not null").groupBy(F.col("review_reason").alias("reason")).agg(F.count("*").alias("n"))


@query(_PERSISTED + """, s as (select x.* from extracted_records x join p using (record_id) where p.action in ('inserted', 'updated'))
 select field, count(*) as n from (select unnest([case when name is not null then 'name' end, case when canonical_url is not null then 'canonical_url' end, case when address is not null then 'address' end, case when telephone is not null then 'telephone' end, case when external_id is not null then 'external_id' end]) field from s
 union all select k from (select unnest(json_keys(fields_json)) k from s) where k not in ('name','canonical_url','address','telephone','external_id')) where field is not null group by 1""")
def persisted_evidence(spark, d):
    return P.stored_evidence(_persisted(spark, d), ["record_id"]).groupBy("field").agg(F.count("*").alias("n"))


# ---- runs: a job's day of fetches; every fetch tries to finish it, the first counts ----

_RUNS = """with f as (select *, job_id || ':' || strftime(fetched_at, '%Y-%m-%d') as run_id from fetch_results where fetched_at is not null),
 s as (select run_id, min(job_id) as job_id, cast(min(date_trunc('day', fetched_at)) as timestamp) as started_at from f group by 1),
 e as (select run_id, fetched_at as at, case when ok then 'completed' when blocked then 'failed' end as status, cast(coalesce(not ok, false) as int) as error_count, row_number() over (partition by run_id order by fetched_at, fetch_id) n from f where ok or blocked),
 h as (select s.run_id, s.job_id, s.started_at, coalesce(e.status, 'running') as status, e.at as finished_at, (epoch_us(e.at) - epoch_us(s.started_at)) / 1e6 as duration_seconds, coalesce(e.error_count, 0) as error_count from s left join e on e.run_id = s.run_id and e.n = 1)"""


def _history(spark, d):
    f = table(spark, d, "fetch_results").where("fetched_at is not null").withColumn("run_id", F.concat_ws(":", "job_id", F.date_format("fetched_at", "yyyy-MM-dd")))
    starts = f.groupBy("run_id").agg(F.min("job_id").alias("job_id"), F.date_trunc("day", F.min("fetched_at")).cast("timestamp_ntz").alias("started_at"))
    ends = f.where("ok or blocked").select("run_id", F.col("fetched_at").alias("at"), F.col("fetch_id").alias("seq"), F.when(F.col("ok"), "completed").otherwise("failed").alias("status"), F.coalesce((~F.col("ok")).cast("int"), F.lit(0)).alias("error_count"))
    return L.run_history(starts, ends)


@query(_RUNS + " select run_id, job_id, status, duration_seconds, error_count from h")
def run_history(spark, d):
    return _history(spark, d).select("run_id", "job_id", "status", "duration_seconds", "error_count")


@query(_RUNS + " select job_id, array_to_string(list_sort(list(run_id) filter (status <> 'completed')), ',') as run_ids, count(*) filter (status <> 'completed') as n from h group by 1 having n > 0")
def unfinished_runs(spark, d):
    return L.unfinished(_history(spark, d), ["job_id"]).where("n > 0").select("job_id", F.array_join("run_ids", ",").alias("run_ids"), "n")


@query(_RUNS + f" select count(*) as n from h where started_at > timestamp '{AS_OF}' - interval 1 day and started_at <= timestamp '{AS_OF}' and error_count > 0")
def recent_errors(spark, d):
    h = _history(spark, d)
    return h.where((F.col("started_at") > _as_of() - F.expr("interval 1 day")) & (F.col("started_at") <= _as_of()) & (F.col("error_count") > 0)).agg(F.count("*").alias("n"))


@query(_RUNS + " select job_id, run_id, status from (select *, row_number() over (partition by job_id order by started_at desc, run_id) n from h) where n <= 20")
def job_runs(spark, d):
    return R.first_of(_history(spark, d), ["job_id"], [F.desc("started_at"), "run_id"], 20).select("job_id", "run_id", "status")


@query(f"select job_id, count(*) filter (created_at < timestamp '{_EARLIER}') as before, count(*) filter (created_at < timestamp '{AS_OF}') as after, count(*) filter (created_at < timestamp '{AS_OF}') - count(*) filter (created_at < timestamp '{_EARLIER}') as delta from entities group by 1")
def entity_growth(spark, d):
    return L.growth(table(spark, d, "entities"), "job_id", "created_at", _at(_EARLIER), _as_of())


@query("""select job_id, batch_no, count(*) as found, count(*) filter (place = 1) as fresh from (select job_id, batch_no, row_number() over (partition by job_id, coalesce(stable_id, url) order by batch_no nulls last, discovered_at nulls last, url) place from discovered_urls) group by 1, 2""")
def discovery_stats(spark, d):
    from pyspark.sql import Window

    u = table(spark, d, "discovered_urls")
    w = Window.partitionBy("job_id", F.coalesce("stable_id", "url")).orderBy(F.asc_nulls_last("batch_no"), F.asc_nulls_last("discovered_at"), "url")
    return u.select("job_id", "batch_no", F.row_number().over(w).alias("place")).groupBy("job_id", "batch_no").agg(F.count("*").alias("found"), F.count_if(F.col("place") == 1).alias("fresh"))


# ---- counters, seeds, candidates and reviews ----


@query("""select strftime(fetched_at, '%Y-%m-%d') as day, cast(0 as bigint) as discovered, count(*) filter (ok) as fetched, cast(0 as bigint) as extracted, cast(0 as bigint) as new_entities, cast(0 as bigint) as updated_entities, cast(0 as bigint) as duplicates, cast(0 as bigint) as reviews, count(*) filter (not ok) as fetch_errors from fetch_results group by 1""")
def counter_totals(spark, d):
    f = table(spark, d, "fetch_results")
    one = f.select(F.date_format("fetched_at", "yyyy-MM-dd").alias("day"), F.explode(F.array(F.when(F.col("ok"), "fetched").otherwise("fetch_errors"), F.lit("no_such_counter"))).alias("counter"), F.lit(1).cast("bigint").alias("by"))
    return L.counter_totals(one)


@query("""select day, total from (select cast(cast(fetched_at as date) as varchar) as day, count(*) as total from fetch_results where fetched_at is not null group by 1) order by day desc limit 14""")
def last_days(spark, d):
    f = table(spark, d, "fetch_results").where("fetched_at is not null")
    return L.page(f.groupBy(F.to_date("fetched_at").cast("string").alias("day")).agg(F.count("*").alias("total")), [F.desc("day")], 14)


@query("""select distinct job_id, url from (select job_id, unnest(from_json(json_extract(config_json, '$.seed_urls'), '["varchar"]')) as url from jobs where json_valid(config_json)) s where not exists (select 1 from fetch_results f where f.job_id = s.job_id and f.url = s.url)""")
def missing_seeds(spark, d):
    return L.missing_seeds(table(spark, d, "jobs"), table(spark, d, "fetch_results").select("job_id", "url").distinct())


_FETCHED = "select job_id, url, fetched_at as t, fetch_id as seq, case when ok then 'accepted' when blocked then 'rejected' else 'review' end as status from fetch_results where fetched_at is not null"


@query(f"with e as ({_FETCHED}), l as (select job_id, url, arg_max(status, (t, seq)) as status from e group by 1, 2) select c.candidate_id, coalesce(l.status, c.status) as status from (select distinct candidate_id, job_id, url, status from entity_candidates) c left join l using (job_id, url)")
def candidate_statuses(spark, d):
    c = table(spark, d, "entity_candidates").select("candidate_id", "job_id", "url", "status", "reviewed_at").dropDuplicates(["candidate_id"])
    f = table(spark, d, "fetch_results").where("fetched_at is not null").select("job_id", "url", F.col("fetched_at").alias("at"), F.col("fetch_id").alias("seq"), F.when(F.col("ok"), "accepted").when(F.col("blocked"), "rejected").otherwise("review").alias("status"))
    return L.with_status(c, f.join(c.select("candidate_id", "job_id", "url"), ["job_id", "url"]).drop("job_id", "url"), "candidate_id").select("candidate_id", "status")


@query("""with r as (select fetch_id, url, fetched_at, case when blocked and lower(coalesce(error, '')) like '%captcha%' then 'captcha' when blocked then 'blocked' else 'parse_failure' end as reason from fetch_results where not ok or blocked),
 o as (select * from r where not exists (select 1 from fetch_results f where f.url = r.url and f.ok and not f.blocked and f.fetched_at > r.fetched_at)) select fetch_id, reason from o order by fetched_at desc, fetch_id limit 500""")
def open_reviews(spark, d):
    f = table(spark, d, "fetch_results")
    added = f.where("not ok or blocked").select(F.col("fetch_id").alias("review_id"), "url", F.col("fetched_at").alias("created_at"), F.when(F.col("blocked") & F.lower(F.coalesce("error", F.lit(""))).contains("captcha"), "captcha").when(F.col("blocked"), "blocked").otherwise("parse_failure").alias("reason"))
    good = f.where("ok and not blocked").groupBy("url").agg(F.max("fetched_at").alias("at"))  # the last good fetch closes what came before
    closed = added.join(good, "url").where("at > created_at").select("review_id", "at", F.lit(1).alias("seq"), F.lit("resolved").alias("status"))
    return L.page(L.reviews(added, closed).where("status = 'open'"), [F.desc("created_at"), "review_id"], 500).select(F.col("review_id").alias("fetch_id"), "reason")


# ---- rates ----

_RATES = f"""with v as (select {_DOMAIN} as domain, fetched_at as t, fetch_id as seq, ok and not blocked as good, coalesce(retry_after, case when http_status = 429 then 3600 end) as block_s from fetch_results where fetched_at is not null),
 s as (select domain, max(t) last_at, max((t, seq)) filter (good) as okat from v group by 1),
 x as (select v.domain, count(*) n, arg_max(t + to_microseconds(cast(block_s * 1e6 as bigint)), (t, seq)) filter (block_s > 0) as until from v join s using (domain) where not good and (okat is null or (t, seq) > okat) group by 1),
 r as (select s.domain, coalesce(n, 0) as error_count, until as blocked_until, case when timestamp '{AS_OF}' < until then (epoch_us(until) - epoch_us(timestamp '{AS_OF}')) / 1e6 else greatest(0, 5.0 - (epoch_us(timestamp '{AS_OF}') - epoch_us(last_at)) / 1e6) end as wait_s from s left join x using (domain))"""


def _rates(spark, d):
    from ..functions.urls import domain_of

    f = table(spark, d, "fetch_results").where("fetched_at is not null")
    events = f.select(domain_of(F.col("url")).alias("domain"), F.col("fetched_at").alias("at"), F.col("fetch_id").alias("seq"), F.when(F.col("ok") & ~F.col("blocked"), "success").otherwise("error").alias("kind"), F.coalesce("retry_after", F.when(F.col("http_status") == 429, 3600.0)).alias("block_seconds"))
    return L.rate_state(events, _as_of(), F.lit(5.0))


@query(_RATES + " select domain, error_count, blocked_until, round(wait_s, 3) as wait_s, wait_s <= 0 as ready from r")
def rate_state(spark, d):
    return _rates(spark, d).select("domain", "error_count", "blocked_until", F.round("wait_s", 3).alias("wait_s"), "ready")


@query(_RATES + " select round(min(wait_s) filter (wait_s > 0), 3) as least_wait_s, count(*) filter (wait_s <= 0) as n_ready from r")
def readiness(spark, d):
    return L.readiness(_rates(spark, d)).select(F.round("least_wait_s", 3).alias("least_wait_s"), "n_ready")


# ---- queue and job transitions ----

_QUEUE = """with q as (select job_id, url, count(*) as attempts, arg_max(ok, (fetched_at, fetch_id)) as ok, arg_max(blocked, (fetched_at, fetch_id)) as blocked, arg_max(coalesce(http_status, 0), (fetched_at, fetch_id)) as http_status, arg_max(coalesce(error, ''), (fetched_at, fetch_id)) as error, max(fetched_at) as fetched_at from fetch_results where fetched_at is not null group by 1, 2),
 r as (select *, case when blocked then 'skipped' when http_status = 304 or ok then 'done' when attempts >= 3 then 'failed' else 'queued' end as queue_status from q)"""


def _queue(spark, d):
    f = table(spark, d, "fetch_results").where("fetched_at is not null")
    last = f.groupBy("job_id", "url").agg(F.count("*").alias("attempts"), F.max_by(F.struct("ok", "blocked", "http_status", "error"), F.struct("fetched_at", "fetch_id")).alias("x"), F.max("fetched_at").alias("fetched_at"))
    return L.fetch_routes(last.select("job_id", "url", "attempts", "x.*", "fetched_at").withColumn("max_attempts", F.lit(3)))


@query(_QUEUE + " select job_id, url, queue_status, case when blocked then case when lower(error) like '%captcha%' then 'captcha' else 'blocked' end when queue_status = 'failed' then 'parse_failure' end as review_reason, cast(case when queue_status <> 'done' then 1 else 0 end as int) as errors, queue_status = 'done' and http_status <> 304 as extract from r")
def fetch_routes(spark, d):
    return _queue(spark, d).select("job_id", "url", "queue_status", "review_reason", "errors", "extract")


@query(_QUEUE + " select job_id, queue_status as status, count(*) as n from r group by 1, 2")
def queue_counts(spark, d):
    return M.counts(_queue(spark, d).withColumnRenamed("queue_status", "status"), ["job_id", "status"])


@query(_QUEUE + f" select job_id, url, 'queued' as status, 0 as attempt_count from r where queue_status = 'done' and fetched_at < timestamp '{AS_OF}' - interval 30 day order by fetched_at, url limit 500")
def revalidated(spark, d):
    q = _queue(spark, d).select("job_id", "url", F.col("queue_status").alias("status"), F.col("attempts").alias("attempt_count"), "fetched_at")
    return L.revalidated(q, _as_of(), 30 * 86400.0, "url").select("job_id", "url", "status", "attempt_count")


@query(_QUEUE + f" select job_id, url, case when queue_status = 'queued' and fetched_at < timestamp '{AS_OF}' - interval 1 day then 'queued' when queue_status = 'queued' then 'fetching' else queue_status end as status from r")
def requeued(spark, d):
    q = _queue(spark, d).select("job_id", "url", F.when(F.col("queue_status") == "queued", "fetching").otherwise(F.col("queue_status")).alias("status"), F.col("fetched_at").alias("claimed_at"))
    return L.requeued(q, _as_of(), 86400.0).select("job_id", "url", "status")


@query("select job_id, case when status = 'queued' and enabled then 'running' else status end as status, status = 'queued' and enabled as changed from jobs")
def claimed_jobs(spark, d):
    return L.moved(table(spark, d, "jobs"), ["queued"], "running", F.col("enabled")).select("job_id", "status", "changed")


@query(f"select job_id from jobs where status in ('queued', 'running', 'continuing') and last_started_at < timestamp '{AS_OF}' - interval 300 second")
def stale_jobs(spark, d):
    running = L.moved(table(spark, d, "jobs"), ["queued", "continuing"], "running")
    return L.stale_jobs(running, _as_of()).select("job_id")


@query("select job_id from jobs where enabled and category = 'facility'")
def facility_jobs(spark, d):
    return L.matching(table(spark, d, "jobs"), status=None, enabled=True, category="facility").select("job_id")


@query(_QUEUE + ", m as (select job_id from r where queue_status = 'queued' union select job_id from entity_candidates where status = 'new') select job_id, case when job_id in (select job_id from m) then 'continuing' else 'completed' end as next_status from jobs")
def next_statuses(spark, d):
    return L.after_run(table(spark, d, "jobs"), _queue(spark, d).select("job_id", F.col("queue_status").alias("status")), table(spark, d, "entity_candidates")).select("job_id", "next_status")


# ---- reports ----


@query(f"select job_id, count(*) as total, count(*) filter (cast(created_at as date) = date '{TODAY}') as new_today, count(*) filter (cast(updated_at as date) = date '{TODAY}' and cast(created_at as date) <> date '{TODAY}') as updated_today from entities where deleted_at is null group by 1")
def entities_today(spark, d):
    day = F.lit(TODAY).cast("date")
    new, touched = F.to_date("created_at") == day, F.to_date("updated_at") == day
    return table(spark, d, "entities").where("deleted_at is null").groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(new).alias("new_today"), F.count_if(touched & ~new).alias("updated_today"))


_SCALARS = f"""select (select count(*) from jobs) as jobs_total, (select count(*) from jobs where enabled) as jobs_active, (select count(*) from jobs where status = 'queued') as jobs_queued, (select count(*) from jobs where status = 'failed') as jobs_failed,
 (select count(*) from entity_candidates where status = 'review') as review_open, (select count(*) from entities where cast(created_at as date) = date '{TODAY}') as new_entities, (select count(*) from entities where deleted_at is null) as entities, (select count(*) from fetch_results where not ok) as fetch_errors"""


@query(_SCALARS)
def status_summary(spark, d):
    j = table(spark, d, "jobs").agg(F.count("*").alias("jobs_total"), F.count_if("enabled").alias("jobs_active"), F.count_if(F.col("status") == "queued").alias("jobs_queued"), F.count_if(F.col("status") == "failed").alias("jobs_failed"))
    c = table(spark, d, "entity_candidates").agg(F.count_if(F.col("status") == "review").alias("review_open"))
    e = table(spark, d, "entities").agg(F.count_if(F.to_date("created_at") == F.lit(TODAY).cast("date")).alias("new_entities"), F.count_if(F.col("deleted_at").isNull()).alias("entities"))
    f = table(spark, d, "fetch_results").agg(F.count_if(~F.col("ok")).alias("fetch_errors"))
    return j.join(c).join(e).join(f)  # one row each


@query(_RUNS + f" select (select count(*) from jobs) as jobs_total, (select count(*) from jobs where status = 'failed') as jobs_failed, (select count(*) from jobs where status = 'running' and last_started_at < timestamp '{AS_OF}' - interval 300 second) as jobs_stale, (select count(*) from h where error_count > 0 and started_at > timestamp '{AS_OF}' - interval 30 day and started_at <= timestamp '{AS_OF}') as runs_with_errors")
def health(spark, d):
    jobs = table(spark, d, "jobs")
    j = jobs.agg(F.count("*").alias("jobs_total"), F.count_if(F.col("status") == "failed").alias("jobs_failed"))
    s = L.stale_jobs(jobs, _as_of()).agg(F.count("*").alias("jobs_stale"))
    h = _history(spark, d).where((F.col("error_count") > 0) & (F.col("started_at") > _as_of() - F.expr("interval 30 days")) & (F.col("started_at") <= _as_of())).agg(F.count("*").alias("runs_with_errors"))
    return j.join(s).join(h)  # one row each


@query(_QUEUE + """ select j.job_id, coalesce(q.n, 0) as links, coalesce(q.done, 0) as done, coalesce(c.n, 0) as candidates, coalesce(c.review, 0) as in_review, coalesce(e.n, 0) as entities from jobs j left join (select job_id, count(*) n, count(*) filter (queue_status = 'done') done from r group by 1) q using (job_id)
 left join (select job_id, count(*) n, count(*) filter (status = 'review') review from entity_candidates group by 1) c using (job_id) left join (select job_id, count(*) n from entities where deleted_at is null group by 1) e using (job_id)""")
def job_detail(spark, d):
    q = _queue(spark, d).groupBy("job_id").agg(F.count("*").alias("links"), F.count_if(F.col("queue_status") == "done").alias("done"))
    c = table(spark, d, "entity_candidates").groupBy("job_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("status") == "review").alias("in_review"))
    e = M.counts(table(spark, d, "entities").where("deleted_at is null"), ["job_id"], "entities")
    return table(spark, d, "jobs").select("job_id").join(q, "job_id", "left").join(c, "job_id", "left").join(e, "job_id", "left").na.fill(0)


@query("select entity_id from entities where deleted_at is null order by updated_at desc, entity_id limit 50 offset 100")
def entity_page(spark, d):
    return L.page(table(spark, d, "entities").where("deleted_at is null"), [F.desc("updated_at"), "entity_id"], 50, 100).select("entity_id")


@query("select entity_id, record_id, row_number() over (partition by entity_id order by extracted_at desc, record_id) as place from extracted_records where entity_id is not null")
def provenance(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("entity_id").orderBy(F.desc("extracted_at"), "record_id")
    return table(spark, d, "extracted_records").where("entity_id is not null").select("entity_id", "record_id", F.row_number().over(w).cast("bigint").alias("place"))


_FIRST_PREFECTURE = "case " + " ".join(f"when contains(address, '{p}') then '{p}'" for p in [*D.PREFECTURES, "県"]) + " end"


@query(f"select {_FIRST_PREFECTURE} as prefecture, count(*) as n from entities group by 1")
def prefectures(spark, d):
    return L.first_contained(table(spark, d, "entities"), "address", [*D.PREFECTURES, "県"], "prefecture").groupBy("prefecture").agg(F.count("*").alias("n"))


@query("select candidate_id, fetch_id from fetch_results f left join (select job_id, url, candidate_id, row_number() over (partition by job_id, url order by discovered_at desc, candidate_id) n from entity_candidates) c on c.job_id = f.job_id and c.url = f.url and c.n = 1")
def fetched_candidates(spark, d):
    newest = R.first_of(table(spark, d, "entity_candidates").select("job_id", "url", "candidate_id", "discovered_at"), ["job_id", "url"], [F.desc("discovered_at"), "candidate_id"])
    return table(spark, d, "fetch_results").select("job_id", "url", "fetch_id").join(newest, ["job_id", "url"], "left").select("candidate_id", "fetch_id")
