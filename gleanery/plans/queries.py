"""The registered queries of the engine's own operators, with DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as X
from ..functions import urls as U
from ..operators import discover as D
from ..operators import extract as E
from ..operators import fetched as H
from ..operators import frontier as Q
from ..operators import monitor as M
from ..operators import resolve as R
from ..session import shared_dir, table

QUERIES, SQL = {}, {}
AS_OF = "2025-10-01 00:00:00"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


_DOMAIN = r"lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"

# A link in normal form, as far as the tables' links go (plain parameters).
_PLAIN_URL = r"""
  with parts as (
    select {keys}, regexp_replace(trim({col}, E' \t\r\n'), '#.*$', '', 's') u from {table}
  ), cut as (
    select {keys}, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) s, lower(regexp_extract(u, '^[^:/]+://([^/?]*)', 1)) h,
      regexp_extract(u, '^[^:/]+://[^/?]*([^?]*)', 1) p, regexp_extract(u, '\?(.*)$', 1) q from parts
  ), links as (
    select {keys}, s || '://' || h || case when regexp_replace(p, '/+$', '') = '' then '/' else regexp_replace(p, '/+$', '') end
      || coalesce(nullif('?' || array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|gclid|fbclid|yclid|mc_cid|mc_eid)='))), '&'), '?'), '') as plain_url
    from cut)
"""


# ---- sources and functions ----


@query(_PLAIN_URL.format(keys="candidate_id", col="url", table="entity_candidates") + "select candidate_id, plain_url from links")
def url_normalize(spark, d):
    return table(spark, d, "entity_candidates").select("candidate_id", U.normalize_url("url").alias("plain_url"))


@query(f"select {_DOMAIN} as host, count(*) as n, count(distinct job_id) as jobs from discovered_urls group by 1")
def domain_stats(spark, d):
    return table(spark, d, "discovered_urls").groupBy(U.domain_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.countDistinct("job_id").alias("jobs"))


@query(r"select doc_id, length(t) as n, sha256(t) as hash from (select doc_id, trim(regexp_replace(coalesce(text,''), '[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) t from documents)")
def whitespace_normalize(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.one_space(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("bigint").alias("n"), F.sha2("t", 256).alias("hash"))


@query()
def name_keys(spark, d):
    return table(spark, d, "entities").select("entity_id", X.name_key(F.col("name")).alias("name_key"), X.address_key(F.col("address")).alias("address_key"), X.phone_key(F.col("telephone")).alias("phone_key"))


@query(r"select fetch_id, nullif(regexp_extract(content, '(0\d{1,4}-\d{1,4}-\d{3,4}|0\d{9,10}|\+81[\d-]{9,13})'), '') as phone from fetch_results")
def phone_search(spark, d):
    return table(spark, d, "fetch_results").select("fetch_id", X.find_phone(F.col("content")).alias("phone"))


@query("select entity_id, coalesce(sha256(case when coalesce(external_id,'')<>'' then 'external_id|'||entity_type||'|'||external_id when coalesce(canonical_url,'')<>'' then 'url|'||entity_type||'|'||canonical_url when coalesce(normalized_name,'')<>'' and coalesce(domain,'')<>'' then 'name_domain|'||entity_type||'|'||normalized_name||'|'||domain when coalesce(normalized_name,'')<>'' then 'name|'||entity_type||'|'||normalized_name end), '') as fingerprint from entities")
def fingerprints(spark, d):
    return R.with_fingerprint(table(spark, d, "entities").drop("fingerprint")).select("entity_id", "fingerprint")


@query("select job_id, schedule, last_started_at + to_seconds(case trim(schedule) when '@minutely' then 60 when '@hourly' then 3600 when '@daily' then 86400 when '@weekly' then 604800 else coalesce(try_cast(regexp_extract(trim(schedule), '^@every\\s+(\\d+)[smhd]$', 1) as bigint) * case regexp_extract(trim(schedule), '^@every\\s+\\d+([smhd])$', 1) when 's' then 1 when 'm' then 60 when 'h' then 3600 when 'd' then 86400 end, 3600) end) as next_at from jobs".replace("\\\\", "\\"))
def next_runs(spark, d):
    return table(spark, d, "jobs").select("job_id", "schedule", K.next_run(F.col("schedule"), F.col("last_started_at")).alias("next_at"))


# ---- fetched pages ----

_OUTCOME = """case when http_status=304 then 'unchanged' when http_status=429 then 'rate_limited' when http_status=403 then 'forbidden' when http_status=404 then 'not_found' when http_status>=500 then 'server_error'
 when not regexp_matches(lower(trim(split_part(coalesce(content_type,''),';',1))), '^($|text/html|application/xhtml\\+xml|application/xml|text/xml|application/json)') then 'unsupported_type'
 when regexp_matches(lower(substring(coalesce(content,''),1,5000)), 'captcha|are you a human|unusual traffic|access denied') then 'blocked_page' else 'ok' end"""


def _outcomes(spark, d):
    return table(spark, d, "fetch_results").withColumn("outcome", H.outcome(F.col("http_status"), F.col("content_type"), F.col("content")))


@query(f"select fetch_id, {_OUTCOME} as outcome from fetch_results")
def fetch_outcomes(spark, d):
    return _outcomes(spark, d).select("fetch_id", "outcome")


@query("select job_id, count(*) filter (http_status between 200 and 299) as http_2xx, count(*) filter (http_status between 300 and 399) as http_3xx, count(*) filter (http_status between 400 and 499) as http_4xx, count(*) filter (http_status between 500 and 599) as http_5xx, count(*) filter (http_status=403) as http_403, count(*) filter (http_status=404) as http_404, count(*) filter (http_status=429) as http_429, count(*) filter (http_status is null) as no_status, count(*) as fetches from fetch_results group by 1")
def http_buckets(spark, d):
    return M.http_buckets(table(spark, d, "fetch_results"), ["job_id"])


@query("select fetch_id, sha256(content) as body_hash, (content is null or lag(sha256(content)) over w is distinct from sha256(content)) as is_changed from fetch_results window w as (partition by url order by fetched_at, fetch_id)")
def changed_pages(spark, d):
    return H.changed(table(spark, d, "fetch_results").select("fetch_id", "url", "fetched_at", "content")).select("fetch_id", "body_hash", "is_changed")


@query()
def page_fields(spark, d):
    p = E.extract_pages(table(spark, d, "fetch_results").where("content is not null"), keep=("fetch_id",))
    return p.select("fetch_id", "page.title", "page.canonical_url", "page.meta_description", "page.name", "page.telephone", F.size("page.links").alias("n_links"), F.size("page.json_ld").alias("n_blocks"))


@query(r"select fetch_id, regexp_extract(content, '<title>([^<]*)</title>', 1) as title from fetch_results where content like '%<title>%'")
def page_titles(spark, d):
    p = E.extract_pages(table(spark, d, "fetch_results").where("content like '%<title>%'"), keep=("fetch_id",))
    return p.select("fetch_id", "page.title")


@query(r"""with l as (select job_id, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) own, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) as root, unnest(list_distinct(regexp_extract_all(content, '<a href="([^"]*)"', 1))) href from fetch_results where content is not null)
 select job_id, case when href like 'http%' then href else root || href end as link, count(*) as n from l where (case when href like 'http%' then lower(regexp_extract(href, '^[^:]+://([^/?#]*)', 1)) else own end) = own group by 1, 2""")
def internal_links(spark, d):
    p = E.extract_pages(table(spark, d, "fetch_results").where("content is not null"), keep=("job_id", "url"))
    found = D.from_links(p.select("job_id", F.col("url").alias("base_url"), F.col("page.links").alias("links")))
    return found.groupBy("job_id", F.col("url").alias("link")).agg(F.count("*").alias("n"))


@query()
def page_records(spark, d):
    p = E.extract_pages(table(spark, d, "fetch_results").where("content is not null"), keep=("fetch_id", "job_id", "url"))
    r = E.get_adapter("local_business")(p).select("fetch_id", "job_id", "record.*").withColumnRenamed("skip", "is_skip")
    return r.select("fetch_id", "name", "telephone", "confidence", F.to_json("fields").alias("fields"), F.array_join(R.problems(r, ["name"]), ",").alias("problems"))


@query("""select fetch_id, json_extract_string(i, '$.name') as name, json_extract_string(i, '$.id') as external_id, json_extract_string(i, '$.url') as url
 from (select fetch_id, unnest(from_json(json_extract(content, '$.items'), '["json"]')) i from fetch_results where content_type = 'application/json' and json_valid(content))""")
def api_items(spark, d):
    f = table(spark, d, "fetch_results").where("content_type = 'application/json'").select("fetch_id", "content")
    return E.api_records(f).select("fetch_id", "name", "external_id", F.col("fields")["url"].alias("url"))


# ---- discovery and queue ----


@query("select job_id, replace(t, '{pref}', p) as url from (select job_id, 'https://example.com/' || category || '/{pref}/' as t, unnest([" + ",".join(f"'{p}'" for p in D.PREFECTURES) + "]) p from jobs)")
def prefecture_links(spark, d):
    jobs = table(spark, d, "jobs").select("job_id", F.concat(F.lit("https://example.com/"), "category", F.lit("/{pref}/")).alias("template"))
    return D.from_prefectures(jobs).select("job_id", "url")


@query("select job_id, 'https://example.com/item/' || n as url from (select job_id, unnest(generate_series(1, max_pages)) n from jobs)")
def range_links(spark, d):
    jobs = table(spark, d, "jobs").select("job_id", F.lit("https://example.com/item/{n}").alias("template"), F.lit(1).alias("first"), F.col("max_pages").alias("last"))
    return D.from_range(jobs).select("job_id", "url")


@query("""select job_id, fingerprint, candidate_id, rank() over (partition by job_id order by candidate_id) as place from (
 select *, row_number() over (partition by job_id, fingerprint order by batch_no, discovered_at, candidate_id) n from entity_candidates where fingerprint is not null) where n = 1""")
def first_candidates(spark, d):
    c = R.first_of(table(spark, d, "entity_candidates").where("fingerprint is not null"), ["job_id", "fingerprint"], ["batch_no", "discovered_at", "candidate_id"])
    return c.select("job_id", "fingerprint", "candidate_id", F.rank().over(Window.partitionBy("job_id").orderBy("candidate_id")).cast("bigint").alias("place"))


@query("select job_id, candidate_id, cast(trunc(50 + confidence * 50) as int) as priority from (select *, row_number() over (partition by job_id order by confidence desc, candidate_id) n from entity_candidates where status = 'new') where n <= 500")
def promoted(spark, d):
    return D.promote(table(spark, d, "entity_candidates")).select("job_id", "candidate_id", "priority")


@query("select distinct job_id, url from discovered_urls d where not exists (select 1 from entity_candidates c where c.job_id = d.job_id and c.url = d.url)")
def unseen_links(spark, d):
    c = table(spark, d, "entity_candidates").select("job_id", "url")
    return table(spark, d, "discovered_urls").select("job_id", "url").distinct().join(c, ["job_id", "url"], "left_anti")


@query("select job_id, url, candidate_id from (select *, row_number() over (partition by job_id, url order by discovered_at desc, candidate_id) n from entity_candidates) where n = 1")
def newest_candidates(spark, d):
    return R.first_of(table(spark, d, "entity_candidates"), ["job_id", "url"], [F.desc("discovered_at"), "candidate_id"]).select("job_id", "url", "candidate_id")


@query(f"select job_id, priority from jobs where enabled and status in ('idle','completed','failed','continuing') and (next_run_at is null or next_run_at <= timestamp '{AS_OF}')")
def due_jobs(spark, d):
    return Q.due(table(spark, d, "jobs"), _as_of()).select("job_id", "priority")


@query(f"select fetch_id, url from fetch_results where fetched_at is null or fetched_at <= timestamp '{AS_OF}' - interval 30 day order by fetched_at nulls first, fetch_id limit 500")
def stale_fetches(spark, d):
    return Q.stale(table(spark, d, "fetch_results"), _as_of(), 30).select("fetch_id", "url")


@query("select fetch_id, attempt, coalesce(retry_after, least(pow(2, attempt), 3600)) as wait_s from (select fetch_id, retry_after, row_number() over (partition by url order by fetched_at, fetch_id) attempt from fetch_results where not ok)")
def retry_waits(spark, d):
    w = Window.partitionBy("url").orderBy("fetched_at", "fetch_id")
    f = table(spark, d, "fetch_results").where("not ok").select("fetch_id", "retry_after", F.row_number().over(w).cast("bigint").alias("attempt"))
    return f.select("fetch_id", "attempt", K.retry_seconds(F.col("attempt"), F.col("retry_after")).alias("wait_s"))


@query(f"with g as (select fetch_id, epoch_us(fetched_at) - epoch_us(lag(fetched_at) over (partition by {_DOMAIN} order by fetched_at, fetch_id)) g from fetch_results) select fetch_id, round(g / 1e6, 3) as gap, coalesce(g / 1e6 < 3600, false) as too_soon from g")
def host_gaps(spark, d):
    f = table(spark, d, "fetch_results").select("fetch_id", "url", "fetched_at")
    return Q.gaps(f, U.domain_of(F.col("url")), F.lit(3600.0)).select("fetch_id", F.round("gap", 3).alias("gap"), "too_soon")


# ---- resolution ----


@query("""select record_id, array_to_string(case when is_skip then ['record_marked_skip'] else list_concat(
  list_transform(list_filter(coalesce(missing_required, []), lambda r: case r when 'name' then coalesce(trim(name),'')='' when 'address' then coalesce(trim(address),'')='' when 'telephone' then coalesce(trim(telephone),'')='' when 'canonical_url' then coalesce(trim(canonical_url),'')='' else true end), lambda r: 'missing_required:' || r),
  list_filter([case when confidence is null or confidence not between 0 and 1 then 'invalid_range:confidence' end, case when coalesce(trim(canonical_url),'')<>'' and not regexp_matches(trim(canonical_url), '^(?i)https?://[^/?#]+') then 'invalid_url:canonical_url' end], lambda x: x is not null)) end, ',') as problems from extracted_records""")
def record_problems(spark, d):
    r = table(spark, d, "extracted_records")
    return r.select("record_id", F.array_join(R.problems(r, []), ",").alias("problems"))


def _candidate_records(spark, d):
    c = table(spark, d, "entity_candidates")
    null = F.lit(None).cast("string")
    rec = c.select("candidate_id", "job_id", "entity_type", "normalized_name", U.domain_of(F.col("url")).alias("domain"), null.alias("address"), null.alias("telephone"), F.trim("url").alias("canonical_url"), F.nullif(F.regexp_extract("fingerprint", r"^[a-z]+:(\d+)$", 1), F.lit("")).alias("external_id"))
    return R.with_fingerprint(rec), R.with_fingerprint(table(spark, d, "entities").drop("fingerprint"))


_FINGERPRINT = "sha256(case when coalesce(external_id,'')<>'' then 'external_id|'||entity_type||'|'||external_id when coalesce(canonical_url,'')<>'' then 'url|'||entity_type||'|'||canonical_url when coalesce(normalized_name,'')<>'' and coalesce(domain,'')<>'' then 'name_domain|'||entity_type||'|'||normalized_name||'|'||domain when coalesce(normalized_name,'')<>'' then 'name|'||entity_type||'|'||normalized_name end)"

# Resolution of records c (id, job_id, fp, u, nn, dom, adr, tel) against entities e.
_RESOLVED = """ f as (select c.id, min(e.entity_id) hit from c join e on c.job_id = e.job_id and c.fp = e.fp group by 1),
 g as (select c.id, min(e.entity_id) hit from c join e on c.job_id = e.job_id and c.u = e.canonical_url where c.u <> '' group by 1),
 h as (select c.id, min(case when (c.dom <> '' and e.domain <> '' and c.dom <> e.domain) or (c.adr <> '' and e.address <> '' and c.adr <> e.address) or (c.tel <> '' and e.telephone <> '' and c.tel <> e.telephone) then '0' else '1' end || e.entity_id) k from c join e on c.job_id = e.job_id and c.nn = e.normalized_name where c.nn <> '' group by 1),
 r as (select c.id, case when f.hit is not null or g.hit is not null then 'merge' when k is not null then 'review' else 'new' end as action, coalesce(f.hit, g.hit, substring(k, 2)) as entity_id,
   case when f.hit is not null then 'fingerprint match' when g.hit is not null then 'canonical_url match' when k is null then 'no match' when k like '0%' then 'same name but conflicting domain/address/telephone' else 'name matches but no strong corroborating signal' end as reason
  from c left join f using (id) left join g using (id) left join h using (id))"""


@query(r"""with e as (select *, """ + _FINGERPRINT + r""" fp from entities where deleted_at is null),
 b as (select candidate_id id, job_id, entity_type, normalized_name, lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as domain, trim(url) canonical_url, nullif(regexp_extract(fingerprint, '^[a-z]+:(\d+)$', 1), '') external_id from entity_candidates),
 c as (select id, job_id, normalized_name nn, domain dom, null adr, null tel, canonical_url u, """ + _FINGERPRINT + """ fp from b),""" + _RESOLVED + " select id as candidate_id, action, entity_id, reason from r")
def resolved(spark, d):
    return R.resolve(*_candidate_records(spark, d)).select("candidate_id", "action", "entity_id", "reason")


@query()
def resolved_in_order(spark, d):
    rec, ent = _candidate_records(spark, d)
    order = Window.partitionBy("job_id").orderBy("candidate_id")
    return R.resolve_in_order(rec.withColumn("seq", F.row_number().over(order)), ent).groupBy("job_id", "action").agg(F.count("*").alias("n"))


_LAST = "coalesce(arg_max(r.{c}, (r.extracted_at, r.record_id)) filter (trim(coalesce(r.{c},''), E' \\t\\n\\r\\u3000') <> ''), any_value(e.{c})) as {c}"


@query("select e.entity_id, " + ", ".join(_LAST.format(c=c) for c in ("name", "address", "telephone")) + " from entities e left join extracted_records r using (entity_id) group by 1")
def refreshed_entities(spark, d):
    e, r = table(spark, d, "entities"), table(spark, d, "extracted_records")
    return R.refreshed(e, r, ["extracted_at", "record_id"], ["name", "address", "telephone"]).select("entity_id", "name", "address", "telephone")


@query()
def merged_keys(spark, d):
    return R.merged_data(table(spark, d, "entities"), table(spark, d, "extracted_records"), ["extracted_at", "record_id"])


@query("""select field, count(*) as n, count(value) as filled from (
 select 'name' field, name value from extracted_records where name is not null union all select 'canonical_url', canonical_url from extracted_records where canonical_url is not null union all select 'address', address from extracted_records where address is not null
 union all select 'telephone', telephone from extracted_records where telephone is not null union all select 'external_id', external_id from extracted_records where external_id is not null
 union all select k, json_extract_string(j, '$."' || k || '"') from (select fields_json j, unnest(json_keys(fields_json)) k from extracted_records where fields_json is not null and json_valid(fields_json)) where k not in ('name','canonical_url','address','telephone','external_id')) group by 1""")
def evidence_fields(spark, d):
    return R.evidence(table(spark, d, "extracted_records"), ["record_id"]).groupBy("field").agg(F.count("*").alias("n"), F.count("value").alias("filled"))


@query("select entity_id, record_id, confidence from (select *, row_number() over (partition by entity_id order by extracted_at desc, record_id) n from extracted_records where entity_id is not null) where n = 1")
def latest_records(spark, d):
    return R.first_of(table(spark, d, "extracted_records").where("entity_id is not null"), ["entity_id"], [F.desc("extracted_at"), "record_id"]).select("entity_id", "record_id", "confidence")


# ---- monitoring ----


@query("select job_id, status, count(*) as n from entity_candidates group by 1, 2")
def status_counts(spark, d):
    return M.counts(table(spark, d, "entity_candidates"), ["job_id", "status"])


@query("select job_id, (select count(*) from entities e where e.job_id = j.job_id) as entities, (select count(*) from entity_candidates c where c.job_id = j.job_id) as candidates, (select count(*) from fetch_results f where f.job_id = j.job_id) as fetches from jobs j")
def job_overview(spark, d):
    return M.with_counts(table(spark, d, "jobs").select("job_id"), "job_id", entities=table(spark, d, "entities"), candidates=table(spark, d, "entity_candidates"), fetches=table(spark, d, "fetch_results"))


@query("select record_id from extracted_records where entity_id in (select entity_id from entities where job_id in (select job_id from jobs where enabled))")
def enabled_evidence(spark, d):
    e = table(spark, d, "entities").join(table(spark, d, "jobs").where("enabled").select("job_id"), "job_id", "left_semi")
    return table(spark, d, "extracted_records").join(e.select("entity_id"), "entity_id", "left_semi").select("record_id")


@query("select cast(cast(fetched_at as date) as varchar) as day, count(*) as pages, count(*) filter (ok) as fetched, count(*) filter (not ok) as errors, round(count(*) filter (not ok) / count(*), 6) as error_rate from fetch_results group by 1")
def daily_metrics(spark, d):
    f = table(spark, d, "fetch_results").groupBy(F.to_date("fetched_at").cast("string").alias("day")).agg(F.count("*").alias("pages"), F.count_if("ok").alias("fetched"), F.count_if(~F.col("ok")).alias("errors"))
    return f.withColumn("error_rate", F.round(M.error_rate(F.col("errors"), F.col("pages")), 6))


@query("select json_extract_string(data_json, '$.operating_status') as state, count(*) as n from entities where data_json is null or json_valid(data_json) group by 1")
def status_rollup(spark, d):
    return table(spark, d, "entities").where("data_json is null or try_parse_json(data_json) is not null").groupBy(F.get_json_object("data_json", "$.operating_status").alias("state")).agg(F.count("*").alias("n"))


def _runs(spark, d):
    c = table(spark, d, "entity_candidates")
    first = R.first_of(c.select("job_id", "batch_no", "candidate_id", F.coalesce("fingerprint", "url").alias("k")), ["job_id", "k"], ["batch_no", "candidate_id"])
    total, fresh = M.counts(c, ["job_id", "batch_no"], "total"), M.counts(first, ["job_id", "batch_no"], "fresh")
    return total.join(fresh, ["job_id", "batch_no"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))


_RUNS = """with k as (select job_id, batch_no, row_number() over (partition by job_id, coalesce(fingerprint, url) order by batch_no, candidate_id) n from entity_candidates),
 r as (select job_id, batch_no, count(*) total, count(*) filter (n = 1) fresh, count(*) filter (n = 1) / count(*) <= 0.8 as low from k group by 1, 2)"""


@query(_RUNS + """, s as (select *, sum(case when low then 0 else 1 end) over (partition by job_id order by batch_no) island from r)
 select job_id, batch_no, total, fresh, count(*) over t >= 3 and min(total) over t > 0 and bool_and(low) over t as saturated, cast(sum(case when low then 1 else 0 end) over (partition by job_id, island order by batch_no) as bigint) as low_streak
 from s window t as (partition by job_id order by batch_no rows between 4 preceding and current row)""")
def saturation(spark, d):
    return M.saturation(_runs(spark, d), "job_id", "batch_no", rate=0.8).select("job_id", "batch_no", "total", "fresh", "saturated", "low_streak")


@query(_RUNS + " select job_id, batch_no, total from (select *, row_number() over (partition by job_id order by batch_no desc) n from r) where n <= 5")
def last_runs(spark, d):
    return R.first_of(_runs(spark, d), ["job_id"], [F.desc("batch_no")], 5).select("job_id", "batch_no", "total")


@query(_RUNS + " select job_id, cast(sum(total) as bigint) as total, cast(sum(fresh) as bigint) as fresh, count(*) as runs from (select *, row_number() over (partition by job_id order by batch_no) n from r) where n > 10 group by 1")
def batch_slice(spark, d):
    return M.after_first(_runs(spark, d), "job_id", ["batch_no"], 10).groupBy("job_id").agg(F.sum("total").alias("total"), F.sum("fresh").alias("fresh"), F.count("*").alias("runs"))


@query("""select 'confidence' as rule, count(*) filter (confidence is null or confidence not between 0 and 1) as broken from extracted_records
 union all select 'unique:entities(entity_id)', cast(coalesce(sum(n - 1), 0) as bigint) from (select count(*) n from entities group by entity_id)
 union all select 'unique:discovered_urls(job_id,url)', cast(coalesce(sum(n - 1), 0) as bigint) from (select count(*) n from discovered_urls group by job_id, url)
 union all select 'reference:extracted_records.entity_id', count(*) from extracted_records r where entity_id is not null and not exists (select 1 from entities e where e.entity_id = r.entity_id)
 union all select 'reference:entities.job_id', count(*) from entities e where job_id is not null and not exists (select 1 from jobs j where j.job_id = e.job_id)""")
def integrity(spark, d):
    t = {n: table(spark, d, n) for n in ("extracted_records", "entities", "discovered_urls", "jobs")}
    return M.broken_rules(t, [("confidence", "extracted_records", F.col("confidence").between(0, 1))], [("entities", ["entity_id"]), ("discovered_urls", ["job_id", "url"])], [("extracted_records", "entity_id", "entities", "entity_id"), ("entities", "job_id", "jobs", "job_id")])


@query("""select j.job_id, coalesce(c.n, 0) as candidates, coalesce(c.fresh, 0) as new_candidates, coalesce(e.n, 0) as entities, coalesce(f.n, 0) as fetches, coalesce(f.bad, 0) as errors, round(coalesce(f.bad / f.n, 0), 6) as error_rate from jobs j
 left join (select job_id, count(*) n, count(*) filter (status = 'new') fresh from entity_candidates group by 1) c using (job_id) left join (select job_id, count(*) n from entities where deleted_at is null group by 1) e using (job_id)
 left join (select job_id, count(*) n, count(*) filter (not ok) bad from fetch_results group by 1) f using (job_id)""")
def batch_report(spark, d):
    jobs = table(spark, d, "jobs").select("job_id")
    c = table(spark, d, "entity_candidates").groupBy("job_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("status") == "new").alias("new_candidates"))
    f = table(spark, d, "fetch_results").groupBy("job_id").agg(F.count("*").alias("fetches"), F.count_if(~F.col("ok")).alias("errors"))
    out = M.with_counts(jobs, "job_id", entities=table(spark, d, "entities").where("deleted_at is null")).join(c, "job_id", "left").join(f, "job_id", "left")
    return out.na.fill(0).withColumn("error_rate", F.round(M.error_rate(F.col("errors"), F.col("fetches")), 6))


@query()
def queue_stream(spark, d):
    """The fetch log as a stream through the queue's state, run to its end."""
    import uuid

    from ..streaming.queue import track_queue

    t = table(spark, d, "fetch_results")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    where = f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}"
    schema = t.select("job_id", "url", "fetch_id", "ok", "blocked", "retry_after").schema
    t.select(*schema.names).write.parquet(f"{where}/in")
    events = spark.readStream.schema(schema).parquet(f"{where}/in").select("job_id", "url", F.col("fetch_id").alias("seq"), "ok", "blocked", "retry_after")
    stream = track_queue(events).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{where}/out/batch={n}")).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    # A batch returns the keys it touched; the last batch of a key has its state.
    last = spark.read.parquet(f"{where}/out").groupBy("job_id", "url").agg(F.max_by(F.struct("status", "attempts"), "batch").alias("x"))
    return last.select("job_id", "url", "x.status", "x.attempts")
