"""Scalar functions against tables of input and expected value."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.functions import keys as K
from gleanery.functions import text as X
from gleanery.functions import urls as U


def values(spark, rows, f, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "url, want",
    [(None, ""), ("", ""), (" HTTPS://Example.COM/a/b/ ", "https://example.com/a/b"), ("https://example.com", "https://example.com/"), ("https://e.com/x?b=2&a=1&utm_source=q#top", "https://e.com/x?a=1&b=2"), ("https://e.com/x?UTM_Source=1&k=", "https://e.com/x?k="), ("/a", "http:///a"), ("https://u:p@e.com:443/", "https://u:p@e.com:443/"), ("https://e.com/?q=a b~*", "https://e.com/?q=a+b~%2A")],
)
def test_plain_url(url, want):
    assert U.plain_url(url) == want


def test_urls(spark):
    urls = ["https://www.A.com:80/x", "ftp://b.com", "no link", None, "http://10.0.0.1/", "http://localhost/", "https://www.youtube.com/c"]
    assert values(spark, urls, U.domain_of) == ["www.a.com:80", "b.com", "", None, "10.0.0.1", "localhost", "www.youtube.com"]
    assert values(spark, urls, U.site_of)[:4] == ["a.com:80", "b.com", None, None]
    assert values(spark, urls, U.is_http) == [True, False, False, False, True, True, True]
    assert values(spark, urls, U.unsafe_to_fetch) == [False, True, True, True, True, True, False]
    assert values(spark, urls, U.is_social)[-1] is True
    df = spark.createDataFrame([("https://e.com/a/b", "../c"), ("https://e.com/a", None)], "b string, l string")
    assert [r[0] for r in df.select(U.resolve_url("b", "l")).collect()] == ["https://e.com/c", None]


def test_text(spark):
    assert values(spark, ["  a　 b\n", None, ""], X.one_space) == ["a b", "", ""]
    assert values(spark, ["株式会社 Ａｃｍｅ", "Acme Corporation", "Foo-Bar Inc.", None], X.name_key) == ["acme", "acmeoration", "foobar", ""]
    assert values(spark, ["１−２ー３", None], X.address_key) == ["1-2-3", ""]
    assert values(spark, ["03-1234-5678", "+81 3 1234", "0081312345678", "１２３", "", None], X.phone_key) == ["+81312345678", "+8131234", "+81312345678", "123", "", ""]
    assert values(spark, ["call 03-1234-5678 now", "none", None], X.find_phone) == ["03-1234-5678", None, None]
    assert values(spark, ["a &amp; b", None, "x"], X.html_unescape) == ["a & b", None, "x"]
    assert values(spark, [" 　", None, "x"], X.is_blank) == [True, True, False]


def test_keys(spark):
    import hashlib

    df = spark.createDataFrame([("t", "n", "u", "d", "x"), ("t", "n", "u", "d", ""), ("t", "n", None, "d", None), ("t", "n", None, None, None), ("t", None, None, "d", None), ("", "n", None, None, None)], "t string, n string, u string, d string, x string")
    got = [r[0] for r in df.select(K.fingerprint(*map(F.col, "tnudx"))).collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [sha("external_id|t|x"), sha("url|t|u"), sha("name_domain|t|n|d"), sha("name|t|n"), "", sha("name|n")]
    assert values(spark, ["@daily", "@every 5m", "@every x", None, " @weekly "], K.interval_seconds) == [86400, 300, 3600, 3600, 604800]
    df = spark.createDataFrame([(1, None), (20, None), (3, 7.5)], "n int, r double")
    assert [r[0] for r in df.select(K.retry_seconds(F.col("n"), F.col("r"))).collect()] == [2.0, 3600.0, 7.5]
    df = spark.createDataFrame([("12",), ("Wed, 21 Oct 2015 07:28:10 GMT",), ("soon",), (None,)], "h string")
    assert [r[0] for r in df.select(K.retry_after_seconds(F.col("h"), F.lit("2015-10-21 07:28:00"))).collect()] == [12.0, 10.0, None, None]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abAB \t　.-", max_size=12), min_size=1, max_size=8))
def test_one_space_matches_python(spark, rows):
    assert values(spark, rows, X.one_space) == [" ".join(r.split()) for r in rows]
