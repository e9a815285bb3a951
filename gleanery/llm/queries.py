"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .addresses import holders_of, place_pairs, places
from .boilerplate import main_lines
from .common import table
from .formatting import collapse, copy_pairs
from .incremental import repeats
from .packing import fill_report, pack
from .pii import find_items, redact
from .skyline import best_records, current_values
from .skeleton import alike_classes, alike_pairs, read_forms
from .tokens import encode_corpus

READ_FIELDS = ["name", "address", "telephone"]
COPIES = {"texts": ["name", "normalized_name", "telephone"], "urls": ["canonical_url"], "jsons": ["data_json"], "scope": ["job_id"]}


def p1_found(spark, sf_dir):
    return current_values(*(table(spark, sf_dir, t) for t in ("entity_clusters", "entities", "extracted_records")))


def p1_best(spark, sf_dir):
    return best_records(*(table(spark, sf_dir, t) for t in ("entity_clusters", "entities", "extracted_records")))


def p2_found(spark, sf_dir):
    return place_pairs(table(spark, sf_dir, "entities"), table(spark, sf_dir, "extracted_records"))


def p2_places(spark, sf_dir):
    return places(holders_of(table(spark, sf_dir, "entities"), table(spark, sf_dir, "extracted_records")))


def p3_found(spark, sf_dir):
    return main_lines(table(spark, sf_dir, "fetch_results")).select("fetch_id", "line_no")


def p3_text(spark, sf_dir):
    return main_lines(table(spark, sf_dir, "fetch_results"))


def p4_found(spark, sf_dir):
    return repeats(table(spark, sf_dir, "entity_candidates"), table(spark, sf_dir, "entities"), table(spark, sf_dir, "discovered_urls"))


def p5_found(spark, sf_dir):
    return alike_pairs(table(spark, sf_dir, "entities"), READ_FIELDS)


def p5_forms(spark, sf_dir):
    return read_forms(table(spark, sf_dir, "entities"), READ_FIELDS)


def p5_classes(spark, sf_dir):
    return alike_classes(table(spark, sf_dir, "entities"), READ_FIELDS)


def p6_found(spark, sf_dir):
    return copy_pairs(table(spark, sf_dir, "entities"), "entity_id", **COPIES)


def p6_collapsed(spark, sf_dir):
    return collapse(table(spark, sf_dir, "entities"), "entity_id", **COPIES)


def p7_ids(spark, sf_dir):
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_packed(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_containers"))


def p8_report(spark, sf_dir):
    return fill_report(p8_packed(spark, sf_dir), table(spark, sf_dir, "pack_containers"))


def p9_found(spark, sf_dir):
    return find_items(table(spark, sf_dir, "documents"))


def p9_redacted(spark, sf_dir):
    return redact(table(spark, sf_dir, "documents"))


QUERIES = {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}

# ---- SQL ----

_BLANK = "lower(trim({v})) in ('', '-', '--', '―', 'n/a', 'na', 'none', 'null', 'nil', 'unknown', 'tbd', 'tba', '準備中', '未定', '不明', 'なし', '未設定', '未登録', '?', '??', '???')"
_RULES = {
    "name": r"regexp_matches(trim(v), '[\p{L}\p{N}]')",
    "address": r"regexp_matches(trim(v), '[\p{L}\p{N}]')",
    "telephone": r"length(regexp_replace(v, '[^0-9０-９]', '', 'g')) >= 9 and length(replace(regexp_replace(v, '[^0-9０-９]', '', 'g'), substring(regexp_replace(v, '[^0-9０-９]', '', 'g'), 1, 1), '')) > 0",
    "official_url": r"regexp_matches(trim(v), '^(?i)https?://[^/?#\s.]+\.[^/?#\s]+') and not regexp_matches(trim(v), '(?i)[?&](to|url|u|redirect)=')",
    "room_count": "regexp_matches(trim(v), '^0*[1-9][0-9]*$')",
    "opening_hours": r"regexp_matches(trim(v), '(^|\s)([01]?[0-9]|2[0-9]):[0-5][0-9]\s*[-–~〜]\s*([0-2]?[0-9]|3[0-6]):[0-5][0-9]') and not regexp_matches(trim(v), '^0?0:00\s*[-–~〜]\s*0?0:00$')",
    "operating_status": r"regexp_matches(trim(v), '^\p{L}[\p{L} _-]+$') and lower(trim(v)) <> 'status'",
}
_USABLE = " ".join(f"when '{f}' then {r}" for f, r in _RULES.items())

# The value that holds is the last trusted one: the skyline's choice under its policy.
_P1 = f"""with m as (select distinct cluster_id, entity_id from entity_clusters where cluster_id is not null),
 t as (select entity_id, arg_max(confidence, extracted_at) trust from extracted_records where entity_id is not null group by 1),
 v as (select m.cluster_id, e.entity_id, coalesce(e.updated_at, timestamp '0001-01-01') seen, coalesce(t.trust, 0) trust, unnest([{{'f': 'name', 'v': e.name}}, {{'f': 'address', 'v': e.address}}, {{'f': 'telephone', 'v': e.telephone}},
   {", ".join("{'f': '" + f + "', 'v': case when json_valid(e.data_json) then json_extract_string(e.data_json, '$." + f + "') end}" for f in ("official_url", "room_count", "opening_hours", "operating_status"))}]) x from m join entities e using (entity_id) left join t using (entity_id)),
 u as (select cluster_id, entity_id, seen, trust, x.f as field, x.v as v from v where x.v is not null and not {_BLANK.format(v="x.v")}),
 k as (select * from u where case field {_USABLE} end),
 n as (select *, count(*) over (partition by entity_id, cluster_id) complete from k),
 w as (select *, row_number() over (partition by cluster_id, field order by (trust >= 0.6) desc, seen desc, trust desc, complete desc, entity_id) r, min(entity_id) over (partition by cluster_id, field, v) first_id from n),
 c as (select distinct cluster_id, unnest(['name', 'address', 'telephone', 'official_url', 'room_count', 'opening_hours', 'operating_status']) as field from m)
 select c.cluster_id, c.field, w.first_id as entity_id from c left join w on w.cluster_id = c.cluster_id and w.field = c.field and w.r = 1"""

_NUMBER = r"nullif(regexp_extract(regexp_replace(regexp_replace(lower(trim({u})), '^([a-z][a-z0-9+.-]*:)?//[^/?#]*', ''), '#.*$', ''), '(^|[^0-9])0*([1-9][0-9]{{5,}})([^0-9]|$)', 2), '')"
_P4 = rf"""with c as (select distinct candidate_id, job_id, batch_no, coalesce({_NUMBER.format(u="url")}, nullif(regexp_extract(fingerprint, '^[^:/]+:0*([1-9][0-9]{{5,}})$', 1), '')) n from entity_candidates),
 e as (select job_id, coalesce(nullif(regexp_extract(external_id, '^0*([1-9][0-9]{{5,}})$', 1), ''), {_NUMBER.format(u="canonical_url")}) n, min(entity_id) hit from entities group by 1, 2),
 f as (select c.*, e.hit, first_value(candidate_id) over (partition by c.job_id, c.n order by batch_no, candidate_id) first from c left join e on e.job_id = c.job_id and e.n = c.n where c.n is not null),
 p as (select candidate_id a, coalesce(hit, first) b from f where hit is not null or first <> candidate_id)
 select least(a, b) as id_a, greatest(a, b) as id_b from p"""

_FOLD = r"lower(regexp_replace({v}, '[\p{{P}}\p{{S}}\p{{Z}}\p{{Cc}}]+', '', 'g'))"
_P6_FORM = f"""select entity_id, job_id, {_FOLD.format(v="name")} n, {_FOLD.format(v="normalized_name")} m, {_FOLD.format(v="telephone")} t,
 case when canonical_url like '%?%' then {_FOLD.format(v="regexp_replace(canonical_url, '[?][^#]*', '')")} || '?' || array_to_string(list_sort(list_transform(string_split(regexp_extract(trim(canonical_url), '[?]([^#]*)', 1), '&'), lambda p: {_FOLD.format(v="p")})), '&') else {_FOLD.format(v="canonical_url")} end u,
 case when json_valid(data_json) then array_to_string(list_sort(list_transform(json_keys(data_json), lambda k: {_FOLD.format(v="k")} || ':' || {_FOLD.format(v="coalesce(json_extract_string(data_json, '$.\"' || k || '\"'), 'null')")})), ';') else {_FOLD.format(v="data_json")} end j from entities"""
_P6 = f"""with f as ({_P6_FORM}) select a.entity_id as id_a, b.entity_id as id_b from f a join f b on a.job_id = b.job_id and a.n is not distinct from b.n and a.m is not distinct from b.m and a.t is not distinct from b.t and a.u is not distinct from b.u and a.j is not distinct from b.j where a.entity_id < b.entity_id"""
_P6_COUNT = f"with f as ({_P6_FORM}) select min(entity_id) as entity_id, count(*) as n_copies from f group by job_id, n, m, t, u, j"

SQL: dict[str, str] = {"p1_found": _P1, "p4_found": _P4, "p6_found": _P6, "p6_collapsed": _P6_COUNT}
