"""Sources, the versioned store, and the streaming operators."""

import pytest
from pyspark.sql import functions as F

from gleanery.sources import web
from gleanery.store import Store


def test_sitemaps(spark):
    index = '<sitemapindex xmlns="http://x"><sitemap><loc>s2</loc></sitemap><sitemap><loc>s1</loc></sitemap></sitemapindex>'
    urls = '<s:urlset xmlns:s="http://x"><s:url><s:loc>https://e.test/1</s:loc><s:lastmod>2024</s:lastmod></s:url><s:url><s:loc> https://e.test/2 </s:loc></s:url></s:urlset>'
    bodies = spark.createDataFrame([("s1", index), ("s2", urls), ("s3", "<urlset><url>")], "url string, content string")
    roots = spark.createDataFrame([("j", "s1"), ("j", "s3")], "job_id string, url string")
    assert {(r.url, r.lastmod) for r in web.sitemap_links(roots, bodies).collect()} == {("https://e.test/1", "2024"), ("https://e.test/2", None)}


def test_robots(spark):
    rules = spark.createDataFrame([("e.test", "User-agent: *\nDisallow: /private\nSitemap: https://e.test/s.xml")], "domain string, content string")
    links = spark.createDataFrame([("https://e.test/a", "e.test"), ("https://e.test/private/x", "e.test"), ("https://o.test/", "o.test")], "url string, domain string")
    assert {r.url: r.allowed for r in web.allowed_by_robots(links, rules, "bot").collect()} == {"https://e.test/a": True, "https://e.test/private/x": False, "https://o.test/": True}
    assert [r.url for r in web.robots_sitemaps(rules).collect()] == ["https://e.test/s.xml"]


def test_decode_and_saved_pages(spark, tmp_path):
    assert web.decode('<meta charset="shift_jis">日本'.encode("shift_jis")).endswith("日本")
    assert web.decode("é".encode(), None) == "é" and web.decode("é".encode("latin-1"), "latin-1") == "é" and web.decode(b"x", "no-such") == "x"
    (tmp_path / "a.html").write_text("<h1>a</h1>")
    (tmp_path / "b.html").write_text("")
    spark.dataSource.register(web.SavedPages)
    rows = spark.read.format("saved_pages").option("glob", "*.html").load(str(tmp_path)).collect()
    assert {(r.content, r.n_bytes) for r in rows} == {("<h1>a</h1>", 10), ("", 0)}


def test_jobs(spark, tmp_path):
    (tmp_path / "j.yaml").write_text("job_id: j1\njob_name: One\nrate_limit: 2\nconfig: {seed_urls: [https://e.test/]}\n")
    row = web.read_jobs(spark, str(tmp_path)).first()
    assert (row.job_id, row.priority, row.rate_limit, row.enabled, row.config_json) == ("j1", 50, 2.0, True, '{"seed_urls": ["https://e.test/"]}')
    assert web.read_jobs(spark, str(tmp_path / "none")).count() == 0


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert not s.exists("t")
    with pytest.raises(KeyError):
        s.read("t")
    s.append("t", spark.range(3))
    s.append("t", spark.range(3, 5))
    s.update("t", lambda df: df.where("id > 0"))
    s.update("t", lambda df: df.withColumn("x", F.lit(1)))
    assert sorted(r.id for r in s.read("t").collect()) == [1, 2, 3, 4]
    assert sum(p.name.startswith("v-") for p in (tmp_path / "t").iterdir()) == 2


def test_streams(spark, tmp_path):
    from gleanery.streaming.queue import track_hosts, track_queue

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, "j", "a", False, False, None), (2, "j", "a", True, False, None), (3, "j", "a", False, False, None), (1, "j", "b", False, True, None), (1, "j", "c", False, False, 30.0)]
    spark.createDataFrame(rows, "seq int, job_id string, url string, ok boolean, blocked boolean, retry_after double").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))

    def run(df, name):
        out = []
        df.writeStream.outputMode("update").foreachBatch(lambda b, _n: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return out

    assert {(r.url, r.status, r.attempts, r.next_retry_s) for r in run(track_queue(src), "q")} == {("a", "done", 2, None), ("b", "skipped", 1, None), ("c", "queued", 1, 30.0)}
    hosts = run(track_hosts(src.select(F.col("job_id").alias("domain"), F.col("seq").cast("double").alias("at")), 0.5), "h")
    assert [(r.domain, r.requests, r.too_soon, r.last_at) for r in hosts] == [("j", 5, 2, 3.0)]


def test_store_survives_a_writer_that_dies(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path))
    s.write("t", spark.range(3))
    monkeypatch.setattr(Store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        s.append("t", spark.range(3, 5))
    monkeypatch.undo()
    other = Store(spark, str(tmp_path))  # a later session
    assert other.exists("t") and sorted(r.id for r in other.read("t").collect()) == [0, 1, 2]
    files = {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")}
    other.append("t", spark.range(5, 6))
    assert sorted(r.id for r in other.read("t").collect()) == [0, 1, 2, 5] and files <= {p.name for p in (tmp_path / "t").iterdir()}
    assert sorted(r.id for r in other.read("t", 1).collect()) == [0, 1, 2]
    other.compact("t", 1)
    assert sorted(r.id for r in other.read("t").collect()) == [0, 1, 2, 5]
