"""Checks, persist pipeline and ledgers on small fixtures: nulls, ties, repeats and empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from gleanery.operators import ledger as L
from gleanery.operators import persist as P

RECORD = "record_id string, job_id string, entity_type string, name string, normalized_name string, canonical_url string, source_url string, domain string, address string, telephone string, external_id string, confidence double, fields_json string, missing_required array<string>, is_skip boolean, skip_reason string, extracted_at timestamp_ntz"
ENTITY = "entity_id string, job_id string, entity_type string, name string, normalized_name string, canonical_url string, domain string, address string, telephone string, external_id string, fingerprint string, deleted_at timestamp"


def record(i, **kw):
    base = dict(record_id=i, job_id="j", entity_type="shop", name="A", normalized_name="a", canonical_url=f"https://e.test/{i}", source_url=None, domain="e.test", address=None, telephone=None, external_id=None, confidence=0.5, fields_json="{}", missing_required=[], is_skip=False, skip_reason=None, extracted_at=None)
    return tuple((base | kw).values())


def test_checks(spark):
    rows = [
        record("ok"), record("skip", is_skip=True, confidence=7.0), record("name", name=" ", missing_required=["name", "price", "size"], fields_json='{"price": "3", "size": ""}'),
        record("range", confidence=1.5), record("type", confidence=None, fields_json="[1]"), record("json", fields_json="{broken"), record("key", fields_json='{" ": 1}'), record("url", canonical_url="ftp://e.test/x"), record("warn", domain=""), record("none", canonical_url=None, domain=None),
    ]
    df = spark.createDataFrame(rows, RECORD)
    errors, warnings = P.checks(df, ["name"])
    got = {r.record_id: (r.e, r.w) for r in df.select("record_id", errors.alias("e"), warnings.alias("w")).collect()}
    assert got["ok"] == ([], []) and got["skip"] == (["record_marked_skip"], []) and got["name"][0] == ["missing_required:name", "missing_required:size"]
    assert got["range"][0] == ["invalid_range:confidence"] and got["type"][0] == ["invalid_type:fields", "invalid_type:confidence"] and got["json"][0] == ["invalid_type:fields"]
    assert got["key"][0] == ["invalid_fields_key"] and got["url"][0] == ["invalid_url:canonical_url"] and got["warn"] == ([], ["domain_missing_but_derivable"]) and got["none"] == ([], [])


def test_persisted(spark):
    ents = spark.createDataFrame(
        [("e1", "j", "shop", "A", "a", "https://e.test/known", "e.test", "1 Mill Road", None, None, "fp", None), ("e2", "j", "shop", "A", "a", "https://e.test/2", "o.test", None, None, None, "fp2", None), ("e0", "j", "shop", "A", "a", "https://e.test/gone", None, None, None, None, "fp3", dt.datetime(2024, 1, 1))], ENTITY
    )
    rows = [
        record("merge", canonical_url="https://e.test/known"), record("gone", canonical_url="https://e.test/gone", normalized_name="zz"), record("clash", address="2 Mill Road"), record("same", domain=None), record("new", normalized_name="b"), record("bad", name=None), record("skip", is_skip=True, skip_reason="no product"),
        record("source", canonical_url=" ", source_url="https://e.test/known"), record("parse", confidence=2.0),
    ]
    got = P.routed(P.persisted(spark.createDataFrame(rows, RECORD), ents, ["name"])).cache()
    by = {r.record_id: r for r in got.collect()}
    assert {k: (r.action, r.entity_id) for k, r in by.items()} == {"merge": ("updated", "e1"), "gone": ("inserted", None), "clash": ("review", "e1"), "same": ("review", "e1"), "new": ("inserted", None), "bad": ("invalid", None), "skip": ("skip", None), "source": ("updated", "e1"), "parse": ("invalid", None)}
    assert by["clash"].reason.startswith("same name but conflicting") and by["same"].reason.startswith("name matches") and by["skip"].reason == "no product"
    assert by["bad"].review_reason == "missing_required_field" and by["parse"].review_reason == "parse_failure" and by["clash"].review_reason == "duplicate_ambiguity" and by["merge"].candidate_status == "duplicate"
    c = P.outcome_counts(got, ["job_id"]).first()
    assert (c.fetched, c.inserted, c.updated, c.duplicates, c.reviewed, c.rejected) == (9, 2, 2, 2, 4, 1)
    assert {r.record_id for r in P.stored_evidence(got, ["record_id"]).collect()} == {"merge", "gone", "new", "source"}
    assert P.persisted(spark.createDataFrame([], RECORD), ents, ["name"]).count() == 0


def at(h):
    return dt.datetime(2024, 1, 1, h)


def test_runs_finish_once(spark):
    starts = spark.createDataFrame([("r1", "j", at(0)), ("r2", "j", at(1)), ("r3", "k", at(2))], "run_id string, job_id string, started_at timestamp_ntz")
    ends = spark.createDataFrame([("r1", at(2), 2, "failed", 9), ("r1", at(2), 1, "completed", 3), ("r1", at(3), 0, "failed", 9), ("r3", at(4), 1, "failed", None), ("zz", at(4), 1, "completed", 1)], "run_id string, at timestamp_ntz, seq int, status string, fetched_count int")
    runs = L.run_history(starts, ends)
    assert {(r.run_id, r.status, r.duration_seconds, r.fetched_count) for r in runs.collect()} == {("r1", "completed", 7200.0, 3), ("r2", "running", None, 0), ("r3", "failed", 7200.0, 0)}
    assert {r.job_id: (r.run_ids, r.n) for r in L.unfinished(runs, ["job_id"]).collect()} == {"j": (["r2"], 1), "k": (["r3"], 1)}


def test_rates(spark):
    rows = [("a", at(0), 1, "error", 7200.0), ("a", at(1), 2, "error", None), ("b", at(0), 1, "error", 36000.0), ("b", at(1), 2, "success", None), ("c", at(0), 1, "success", None), ("c", at(0), 2, "error", None)]
    state = L.rate_state(spark.createDataFrame(rows, "domain string, at timestamp_ntz, seq int, kind string, block_seconds double"), F.lit("2024-01-01 01:30:00").cast("timestamp_ntz"), F.lit(3600.0))
    got = {r.domain: (r.error_count, r.blocked_until, r.wait_s, r.ready) for r in state.collect()}
    assert got == {"a": (2, at(2), 1800.0, False), "b": (0, None, 1800.0, False), "c": (1, None, 0.0, True)}
    r = L.readiness(state).first()
    assert (r.least_wait_s, r.n_ready) == (1800.0, 1) and [x.domain for x in L.ready_domains(state).collect()] == ["c"]


def test_ledgers(spark):
    deltas = spark.createDataFrame([("d", "fetched", 2), ("d", "fetched", 3), ("d", "other", 9), ("d", "reviews", -1)], "day string, counter string, by int")
    r = L.counter_totals(deltas).first()
    assert (r.fetched, r.reviews, r.discovered) == (5, -1, 0) and "other" not in r.asDict()
    jobs = spark.createDataFrame([("j", '{"seed_urls": ["https://E.test/a/#x", "", "https://e.test/b", "https://e.test/b"]}'), ("k", None), ("l", "{broken")], "job_id string, config_json string")
    queue = spark.createDataFrame([("j", "https://e.test/b")], "job_id string, url string")
    assert [(x.job_id, x.url) for x in L.missing_seeds(jobs, queue).collect()] == [("j", "https://e.test/a")]
    rows = spark.createDataFrame([("c", "new", None), ("d", "new", None)], "candidate_id string, status string, reviewed_at timestamp_ntz")
    events = spark.createDataFrame([("c", at(1), 1, "review"), ("c", at(1), 2, "accepted"), ("c", at(0), 9, "rejected")], "candidate_id string, at timestamp_ntz, seq int, status string")
    assert {(x.candidate_id, x.status, x.reviewed_at) for x in L.with_status(rows, events, "candidate_id").collect()} == {("c", "accepted", at(1)), ("d", "new", None)}
    moved = L.moved(spark.createDataFrame([("a", "queued"), ("b", "running"), ("c", None)], "id string, status string"), ["queued"], "running")
    assert {(x.id, x.status, x.changed) for x in moved.collect()} == {("a", "running", True), ("b", "running", False), ("c", None, False)}


def test_fetch_routes(spark):
    cols = "id string, ok boolean, blocked boolean, http_status int, error string, attempts int, max_attempts int"
    rows = [("ok", True, False, 200, None, 1, 3), ("same", True, False, 304, None, 1, 3), ("robot", True, True, 200, "CAPTCHA seen", 1, 3), ("forbidden", False, True, 403, None, 1, 3), ("again", False, False, 500, None, 2, 3), ("dead", False, False, None, None, 3, 3)]
    got = {r.id: (r.queue_status, r.review_reason, r.errors, r.reviews, r.extract) for r in L.fetch_routes(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"ok": ("done", None, 0, 0, True), "same": ("done", None, 0, 0, False), "robot": ("skipped", "captcha", 1, 1, False), "forbidden": ("skipped", "blocked", 1, 1, False), "again": ("queued", None, 1, 0, False), "dead": ("failed", "parse_failure", 1, 1, False)}


PRODUCT = """<html><head><title>t</title><script type="application/ld+json">{"@type": "Product", "name": "Kit &amp; Box", "sku": "S1", "brand": "Maker", "offers": [{"price": 12.5, "priceCurrency": "EUR"}], "image": "https://e.test/a.jpg"}</script>
<script>dataLayer.push({"ecommerce": {"items": [{"item_id": "I1", "price": "99", "item_category": "toys"}]}, "reservation_deadline": "soon"}); dataLayer.push({"item_category": "models"});</script></head><body><h1>H</h1></body></html>"""


def test_product_pages(spark):
    from gleanery.operators import extract as E

    whole = PRODUCT.replace('"sku": "S1"', '"sku": "S1", "gtin13": "4900000000001"').replace('"brand": "Maker"', '"brand": {"name": "Maker"}').replace('[{"price": 12.5, "priceCurrency": "EUR"}]', '{"priceCurrency": "EUR"}').replace('"https://e.test/a.jpg"', "[" + ", ".join(f'"{k}.jpg"' for k in range(7)) + "]")
    pages = spark.createDataFrame([(1, PRODUCT, "https://e.test/1", "shop"), (2, whole, "https://e.test/2", "shop"), (3, "<h1>List</h1>", "https://e.test/3", "shop"), (4, None, "https://e.test/4", "shop"), (5, '{"items": [{"id": 7, "name": "x", "url": "https://e.test/x", "price": 3}, {"name": "y"}]}', "https://e.test/api", "api"), (6, "{broken", "https://e.test/api", "api"), (7, "<h1>a</h1>", "https://e.test/7", "no such type")], "page_id int, content string, url string, collector_type string")
    rows = {}
    for r in E.records_of(pages, {"shop": "catalogue_product"}, keep=("page_id",)).collect():
        rows.setdefault(r.page_id, []).append(r.record)
    a, b = rows[1][0], rows[2][0]
    assert (a.name, a.external_id, a.confidence, a.skip) == ("Kit & Box", "S1", 0.8, False)
    assert {k: a.fields.get(k) for k in ("brand", "price", "currency", "category", "item_id", "reservation_deadline", "image_urls")} == {"brand": "Maker", "price": "12.5", "currency": "EUR", "category": "models", "item_id": "I1", "reservation_deadline": "soon", "image_urls": '["https://e.test/a.jpg"]'}
    assert (b.external_id, b.fields["brand"], b.fields["price"]) == ("4900000000001", "Maker", "99") and b.fields["image_urls"].count(".jpg") == 5
    assert all(rows[k][0].skip and rows[k][0].skip_reason == "no Product block" and not rows[k][0].fields for k in (3, 4))
    assert sorted((r.name, r.external_id, tuple(r.missing_required)) for r in rows[5]) == [("x", "7", ()), ("y", None, ("external_id",))] and 6 not in rows and 7 not in rows
