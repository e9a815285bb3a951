"""Candidate links: producers with one schema, their union, and what of it is new."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import candidate_fingerprint, fetch_priority
from ..functions.urls import domain_of, normalize_url
from ..schemas import DISCOVERED

# The 47 prefectures and their romanised names, in the usual order.
PREFECTURES = "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県 滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県".split()
PREFECTURE_SLUGS = "hokkaido aomori iwate miyagi akita yamagata fukushima ibaraki tochigi gunma saitama chiba tokyo kanagawa niigata toyama ishikawa fukui yamanashi nagano gifu shizuoka aichi mie shiga kyoto osaka hyogo nara wakayama tottori shimane okayama hiroshima yamaguchi tokushima kagawa ehime kochi fukuoka saga nagasaki kumamoto oita miyazaki kagoshima okinawa".split()
#: Most candidates promoted to the fetch queue at once, per job.
PROMOTED = 500


def _found(df: DataFrame, url, method: str, confidence: float, lastmod=None, stable_id=None) -> DataFrame:
    null = F.lit(None).cast("string")
    return df.select(F.col("job_id"), url.alias("url"), F.lit(method).alias("method"), (null if lastmod is None else lastmod).alias("lastmod"), F.lit(confidence).alias("confidence"), (null if stable_id is None else stable_id).alias("stable_id"))


def from_links(pages: DataFrame, allowed: DataFrame | None = None, pattern: str | None = None) -> DataFrame:
    """Links of (job_id, base_url, links) on the page's own host, or on those of ``allowed`` (job_id, domain).

    With ``pattern`` a link must match it somewhere; its first group is the stable id.
    """
    links = pages.select("job_id", domain_of(F.col("base_url")).alias("own"), F.explode("links").alias("url")).withColumn("domain", domain_of(F.col("url")))
    links = links.where(F.col("domain") == F.col("own")) if allowed is None else links.join(allowed.select("job_id", "domain").distinct(), ["job_id", "domain"], "left_semi")
    stable = None
    if pattern is not None:
        links = links.where(F.col("url").rlike(pattern))
        stable = F.regexp_extract("url", pattern, 1) if re.compile(pattern).groups else None
    return _found(links, F.col("url"), "internal_link", 0.4, stable_id=stable)


def from_related(blocks: DataFrame) -> DataFrame:
    """``sameAs`` links of (job_id, json_ld): a text or a list, http only, of any host."""
    one = blocks.select("job_id", F.explode("json_ld").alias("b")).select("job_id", F.get_json_object("b", "$.sameAs").alias("s"))
    links = one.select("job_id", F.explode(F.coalesce(F.from_json("s", "array<string>"), F.array("s"))).alias("url"))
    return _found(links.where(F.col("url").startswith("http")), F.col("url"), "related_entity", 0.45)


def from_prefectures(jobs: DataFrame, template: str = "template", slugs: bool = False) -> DataFrame:
    """One link per prefecture for every template with the placeholder ``{pref}``."""
    names = F.array(*map(F.lit, PREFECTURE_SLUGS if slugs else PREFECTURES))
    rows = jobs.where(F.col(template).contains("{pref}")).select("job_id", template, F.explode(names).alias("pref"))
    return _found(rows, F.replace(F.col(template), F.lit("{pref}"), F.col("pref")), "prefecture", 0.6)


def from_range(jobs: DataFrame, template: str = "template", first: str = "first", last: str = "last", step: int = 1, mark: str = "{n}") -> DataFrame:
    """One link per number of an inclusive range; templates without the mark give none."""
    rows = jobs.where(F.col(template).contains(mark) & (F.col(first) <= F.col(last))).select("job_id", template, F.explode(F.sequence(F.col(first), F.col(last), F.lit(step))).alias("n"))
    return _found(rows, F.replace(F.col(template), F.lit(mark), F.col("n").cast("string")), "url_pattern", 0.4)


def from_search(queries: DataFrame, results: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` results (query, rank, url) of each query (job_id, query)."""
    return _found(queries.join(results.where(F.col("rank") <= most), "query"), F.col("url"), "search_query", 0.5)


def union_all(spark: SparkSession, frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], DISCOVERED)


def new_candidates(found: DataFrame, stored: DataFrame, entity_type, order: list[str]) -> DataFrame:
    """Found links (job_id, url, stable_id, ...) not stored yet, the first of each (job, fingerprint) by ``order``.

    Links are normalised and blank ones dropped. A null fingerprint never matches.
    """
    rows = found.withColumn("url", normalize_url("url")).where("url != ''").withColumn("fingerprint", candidate_fingerprint(entity_type, F.col("stable_id"), F.col("url")))
    w = Window.partitionBy("job_id", "fingerprint").orderBy(*order)
    first = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.join(stored.select("job_id", "fingerprint").distinct(), ["job_id", "fingerprint"], "left_anti")


def promote(candidates: DataFrame, most: int = PROMOTED) -> DataFrame:
    """Each job's ``most`` best new candidates, with their priority in the fetch queue."""
    w = Window.partitionBy("job_id").orderBy(F.desc("confidence"), "candidate_id")
    return candidates.where("status = 'new'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).withColumn("priority", fetch_priority(F.col("confidence")))


def enqueue(found: DataFrame, queue: DataFrame) -> DataFrame:
    """Links of (job_id, url) not queued yet, in any status, each once."""
    rows = found.withColumn("url", normalize_url("url")).where("url != ''").dropDuplicates(["job_id", "url"])
    return rows.join(queue.select("job_id", "url"), ["job_id", "url"], "left_anti")
