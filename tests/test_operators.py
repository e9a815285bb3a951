"""Operators on small hand-made tables."""

from pyspark.sql import functions as F

from gleanery.operators import discover as D
from gleanery.operators import extract as E
from gleanery.operators import fetched as H
from gleanery.operators import frontier as Q
from gleanery.operators import monitor as M
from gleanery.operators import resolve as R

PAGE = """<html><head><title> Old Mill &amp; Inn </title><link rel="canonical" href="/p/1"><meta name="description" content=" A stay ">
<script type="application/ld+json">{"@graph": [{"@type": ["Product", "Thing"], "name": "Lamp &amp; Co", "sku": "S1", "gtin13": "490", "brand": {"name": "B"}, "sameAs": ["http://o.test/", "x"]}]}</script>
<script type="application/ld+json">{broken</script><script>dataLayer.push({"shop": "q", "ecommerce": {"items": [{"id": "7", "shop": "r"}]}}); dataLayer.push(x)</script></head>
<body><h1>Head</h1><p>Ring 03-1234-5678</p><a href="/a">a</a><a href="/a">b</a><a href="mailto:x">m</a><a href="https://www.facebook.com/z">f</a><img src="i.png"><p>unclosed</body>"""


def test_read_page():
    p = E.read_page(PAGE, "https://e.test/x/y")
    assert p["title"] == "Old Mill & Inn" and p["canonical_url"] == "https://e.test/p/1" and p["meta_description"] == "A stay"
    assert p["name"] == "Lamp & Co" and p["telephone"] == "03-1234-5678" and len(p["json_ld"]) == 1
    assert p["links"] == ["https://e.test/a", "https://www.facebook.com/z"] and p["social_urls"] == ["https://www.facebook.com/z"] and p["image_urls"] == ["https://e.test/x/i.png"]
    assert p["data_layer"] == ['{"shop": "r", "id": "7"}']
    assert E.read_page(None, None)["links"] == [] and E.read_page("", "b")["canonical_url"] == "b"


def test_adapters_and_api(spark):
    pages = E.extract_pages(spark.createDataFrame([(1, PAGE, "https://e.test/x/y"), (2, None, None)], "id int, content string, url string"), keep=("id",))
    rec = E.get_adapter("product")(pages).select("id", "record.*").orderBy("id").collect()
    assert rec[0].external_id == "490" and rec[0].fields["brand"] == "B" and rec[0].confidence == 0.75 and rec[0].missing_required == []
    assert rec[1].missing_required == ["name"] and rec[1].confidence == 0.5
    related = D.from_related(pages.select(F.lit("j").alias("job_id"), F.col("page.json_ld").alias("json_ld")))
    assert [r.url for r in related.collect()] == ["http://o.test/"]
    api = spark.createDataFrame([('{"items": [{"id": 1, "name": "a", "k": "v"}]}',), ('[{"id": "2", "name": "b"}]',), ('{"data": []}',), ("{oops",), (None,)], "content string")
    got = {(r.external_id, r.name, r.fields.get("k")) for r in E.api_records(api).collect()}
    assert got == {("1", "a", "v"), ("2", "b", None)}


def test_outcome(spark):
    rows = [(304, None, None), (429, "", ""), (403, "", ""), (404, "", ""), (503, "", ""), (200, "image/png", ""), (200, "text/html; charset=x", "Show you are no robot: CAPTCHA"), (200, "text/html", "fine"), (410, None, None)]
    df = spark.createDataFrame(rows, "s int, t string, b string")
    assert [r[0] for r in df.select(H.outcome(F.col("s"), F.col("t"), F.col("b"))).collect()] == ["unchanged", "rate_limited", "forbidden", "not_found", "server_error", "unsupported_type", "blocked_page", "ok", "ok"]


def test_discovery(spark):
    pages = spark.createDataFrame([("j", "https://e.test/", ["https://e.test/product/12/a", "https://e.test/about", "https://o.test/product/9/"])], "job_id string, base_url string, links array<string>")
    assert [(r.url, r.stable_id) for r in D.from_links(pages, pattern=r"/product/(\d+)/").collect()] == [("https://e.test/product/12/a", "12")]
    assert D.from_links(pages).count() == 2
    allowed = spark.createDataFrame([("j", "o.test")], "job_id string, domain string")
    assert D.from_links(pages, allowed).count() == 1
    jobs = spark.createDataFrame([("j", "x/{pref}", 1, 3), ("k", "none", 1, 3)], "job_id string, template string, first int, last int")
    assert D.from_prefectures(jobs).count() == 47 and D.from_prefectures(jobs, slugs=True).first().url == "x/hokkaido"
    assert D.from_range(jobs.withColumn("template", F.lit("p{n}"))).where("job_id='j'").count() == 3 and D.from_range(jobs).count() == 0
    assert D.union_all(spark, []).count() == 0
    found = spark.createDataFrame([("j", "https://e.test/a#x", None, 2), ("j", "https://e.test/a", None, 1), ("j", "", None, 3), ("j", "https://e.test/b", "7", 4)], "job_id string, url string, stable_id string, seq int")
    stored = spark.createDataFrame([("j", "shop:7")], "job_id string, fingerprint string")
    new = D.new_candidates(found, stored, F.lit("shop"), ["seq"]).collect()
    assert [(r.url, r.seq) for r in new] == [("https://e.test/a", 1)]
    assert D.enqueue(found, spark.createDataFrame([("j", "https://e.test/b")], "job_id string, url string")).count() == 1


ENT = "entity_id string, job_id string, fingerprint string, canonical_url string, normalized_name string, domain string, address string, telephone string, deleted_at timestamp"
REC = "seq int, job_id string, fingerprint string, canonical_url string, normalized_name string, domain string, address string, telephone string"


def test_resolve(spark):
    ents = spark.createDataFrame([("e1", "j", "f1", "u1", "n1", "d1", None, None, None), ("e2", "j", "f2", "u2", "n2", "d2", "a2", None, None), ("e3", "j", "f3", "u3", "n2", "d3", None, None, None)], ENT)
    recs = spark.createDataFrame([(1, "j", "f1", "zz", "n2", None, None, None), (2, "j", "f9", "u2", "x", None, None, None), (3, "j", "f9", "u9", "n2", "d3", None, None), (4, "j", "f9", "u9", "n1", "d1", None, None), (5, "j", "", None, None, None, None, None), (6, "k", "f1", "u1", "n1", None, None, None)], REC)
    got = {r.seq: (r.action, r.entity_id) for r in R.resolve(recs, ents).collect()}
    assert got == {1: ("merge", "e1"), 2: ("merge", "e2"), 3: ("review", "e2"), 4: ("review", "e1"), 5: ("new", None), 6: ("new", None)}
    same = {r.seq: r.action for r in R.resolve_in_order(recs.where("seq < 5"), ents).collect()}
    assert same == {1: "merge", 2: "merge", 3: "review", 4: "new"}  # 1 renamed e1, so 4 no longer meets its name


def test_resolve_in_order_sees_earlier_records(spark):
    ents = spark.createDataFrame([], ENT)
    recs = spark.createDataFrame([(1, "j", "f1", "u1", "n1", "d", None, None), (2, "j", "f1", "u2", "n2", "d", None, None), (3, "j", "f5", "u2", "n5", "d", None, None), (4, "j", "f6", "u6", "n5", "e", None, None), (5, "j", "f6", "u7", "n9", "e", None, None)], REC)
    got = {r.seq: (r.action, r.entity_id) for r in R.resolve_in_order(recs, ents).collect()}
    first = "new-000000000001"
    # 2 merges by fingerprint and moves the link to u2, which 3 then finds; 4 has its name and another domain; 5's fingerprint was never stored.
    assert got == {1: ("new", first), 2: ("merge", first), 3: ("merge", first), 4: ("review", first), 5: ("new", "new-000000000005")}


def test_problems(spark):
    df = spark.createDataFrame([("n", "https://e.test/", 0.5, [], False), ("", "ftp://x", 1.5, ["address", "address"], False), (None, None, None, None, True), ("n", None, 0.0, ["name"], None)], "name string, canonical_url string, confidence double, missing_required array<string>, is_skip boolean").withColumn("address", F.lit(None).cast("string"))
    got = [r[0] for r in df.select(R.problems(df, ["name"])).collect()]
    assert got == [[], ["missing_required:name", "missing_required:address", "invalid_range:confidence", "invalid_url:canonical_url"], ["record_marked_skip"], []]


def test_merge_and_upsert(spark):
    e = spark.createDataFrame([("e1", "old", '{"a": "1", "b": "2"}', "2024-01-01")], "entity_id string, name string, data_json string, updated_at string")
    r = spark.createDataFrame([("e1", "new", '{"b": null, "c": "3"}', "2024-02-01", "r1"), ("e1", "  ", '{"c": "4"}', "2024-03-01", "r2"), (None, "x", "{}", "2024-04-01", "r3")], "entity_id string, name string, fields_json string, extracted_at string, record_id string")
    row = R.refreshed(e, r, ["extracted_at", "record_id"], ["name"]).first()
    assert (row.name, row.updated_at) == ("new", "2024-03-01")
    assert {(x.key, x.value) for x in R.merged_data(e, r, ["extracted_at", "record_id"]).collect()} == {("a", "1"), ("b", None), ("c", "4")}
    old = spark.createDataFrame([("j1", "run", 1), ("j2", "idle", 2)], "id string, phase string, v int")
    new = spark.createDataFrame([("j2", "boot", 9), ("j3", "boot", 8)], "id string, phase string, v int")
    assert sorted(map(tuple, R.upsert(old, new, ["id"], ["phase"]).collect())) == [("j1", "run", 1), ("j2", "idle", 9), ("j3", "boot", 8)]
    ev = R.evidence(spark.createDataFrame([("r", "n", None, None, None, None, '{"name": "raw", "k": null}')], "record_id string, name string, canonical_url string, address string, telephone string, external_id string, fields_json string"), ["record_id"])
    assert {(x.field, x.value) for x in ev.collect()} == {("name", "n"), ("k", None)}


def test_queue(spark):
    q = spark.createDataFrame([(1, "j", "u1", "d", 50, "queued", 0, None), (2, "j", "u2", "d", 90, "queued", 0, None), (3, "j", "u3", "d", 99, "done", 0, None), (4, "k", "u4", "o", 10, "queued", 0, "2030-01-01 00:00:00")], "queue_id int, job_id string, url string, domain string, priority int, status string, attempt_count int, next_retry_at string").withColumn("next_retry_at", F.col("next_retry_at").cast("timestamp"))
    now = F.lit("2025-01-01").cast("timestamp")
    assert [r.queue_id for r in Q.claim(q, now, 1).collect()] == [2]
    assert Q.claim(q, now, 5, spark.createDataFrame([("o",)], "domain string")).count() == 0
    done = q.where("queue_id < 4").withColumn("max_attempts", F.lit(2)).withColumn("ok", F.col("queue_id") == 1).withColumn("blocked", F.col("queue_id") == 2).withColumn("retry_after", F.lit(None).cast("double")).withColumn("now", now)
    assert [(r.status, r.attempt_count) for r in Q.after_fetch(done).orderBy("queue_id").collect()] == [("done", 1), ("skipped", 1), ("queued", 1)]
    assert [r.starts_after for r in Q.schedule(q, 2.0).where("domain='d'").orderBy("starts_after").collect()] == [0.0, 2.0, 4.0]


def test_monitor(spark):
    runs = spark.createDataFrame([("j", i, t, f) for i, (t, f) in enumerate([(10, 9), (10, 0), (10, 0), (10, 0), (0, 0), (10, 5)])], "job_id string, n int, total int, fresh int")
    got = [(r.saturated, r.low_streak) for r in M.saturation(runs, "job_id", "n").orderBy("n").collect()]
    assert got == [(False, 0), (False, 1), (False, 2), (False, 3), (False, 4), (False, 0)]
    calm = spark.createDataFrame([("j", i, 100, 1) for i in range(3)], "job_id string, n int, total int, fresh int")
    assert [r.saturated for r in M.saturation(calm, "job_id", "n").orderBy("n").collect()] == [False, False, True]
    assert M.after_first(runs, "job_id", ["n"], 4).count() == 2
    t = {"a": spark.createDataFrame([(1, 5), (1, 6), (None, 7)], "id int, ref int"), "b": spark.createDataFrame([(5,)], "id int")}
    got = {r.rule: r.broken for r in M.broken_rules(t, [("id set", "a", F.col("id").isNotNull())], [("a", ["id"])], [("a", "ref", "b", "id")]).collect()}
    assert got == {"id set": 1, "unique:a(id)": 1, "reference:a.ref": 2}
