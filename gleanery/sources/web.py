"""Sitemaps, robots rules, saved page bodies, API answers and job files as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path
from urllib.robotparser import RobotFileParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.resolve import first_of

#: Most links a job takes from sitemaps, and how deep index files may nest.
MOST_LINKS, DEPTH = 5000, 3
_CHARSET = re.compile(rb"<meta[^>]+charset=[\"']?\s*([A-Za-z0-9_-]+)", re.I)


def sitemap_entries(df: DataFrame, body: str = "content") -> DataFrame:
    """(all columns of ``df`` but the body, loc, lastmod, is_index) of each entry; broken XML gives none."""
    xml = F.regexp_replace(body, r"<(/?)[A-Za-z0-9]+:", "<$1")  # prefixes of the sitemap namespace
    kind = "url array<struct<loc:string,lastmod:string>>, sitemap array<struct<loc:string,lastmod:string>>"
    x = df.withColumn("_x", F.from_xml(xml, kind, {"mode": "PERMISSIVE"})).drop(body)
    part = lambda c, index: x.withColumn("_e", F.explode(f"_x.{c}")).select(*(k for k in x.columns if k != "_x"), F.trim("_e.loc").alias("loc"), F.col("_e.lastmod").alias("lastmod"), F.lit(index).alias("is_index"))
    return part("url", False).unionByName(part("sitemap", True)).where("loc != ''")


def sitemap_links(roots: DataFrame, bodies: DataFrame, depth: int = DEPTH, most: int = MOST_LINKS) -> DataFrame:
    """(job_id, url, lastmod) reached from ``roots`` (job_id, url) through ``bodies`` (url, content); index files up to ``depth``.

    A job takes ``most`` links, the first by address; that is a limit on what is fetched.
    """
    level, out = roots.select("job_id", "url"), None
    for _ in range(depth + 1):
        entries = sitemap_entries(level.join(bodies, "url").select("job_id", "content"))
        found = entries.where("not is_index").select("job_id", F.col("loc").alias("url"), "lastmod")
        out = found if out is None else out.unionByName(found)
        level = entries.where("is_index").select("job_id", F.col("loc").alias("url")).distinct()
    return first_of(out.dropDuplicates(["job_id", "url"]), ["job_id"], ["url"], most)


def robots_sitemaps(df: DataFrame, body: str = "content") -> DataFrame:
    return df.withColumn("url", F.explode(F.regexp_extract_all(F.col(body), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1)))).drop(body)


def allowed_by_robots(links: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Adds ``allowed`` to links (url, domain) by the rules (domain, content) of their host; a host without rules allows all."""

    @F.pandas_udf("boolean")
    def ok(text: pd.Series, url: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser] = {}

        def one(t: str | None, u: str) -> bool:
            if t is None:
                return True
            if t not in parsers:
                parsers[t] = RobotFileParser()
                parsers[t].parse(t.splitlines())
            return parsers[t].can_fetch(agent, u)

        return pd.Series([one(t, u) for t, u in zip(text, url)], dtype=bool)

    return links.join(rules.select("domain", F.col("content").alias("_rules")), "domain", "left").withColumn("allowed", ok("_rules", "url")).drop("_rules")


def decode(raw: bytes, declared: str | None = None) -> str:
    """Text of a body: by the declared charset, else the one its markup names, else UTF-8."""
    named = m[1].decode("ascii", "ignore") if (m := _CHARSET.search(raw[:4096])) else None
    for name in (declared, named):
        if name:
            try:
                return raw.decode(name, errors="replace")
            except LookupError:
                pass
    return raw.decode("utf-8", errors="replace")


class SavedPages(DataSource):
    """``spark.read.format("saved_pages").load(folder)``: bodies saved under a folder, one file each.

    Options: ``glob`` (default ``*``) and ``charset``. Columns: path, content,
    n_bytes. Every file is a partition of its own, so large folders are read by
    the whole cluster; the folder must be visible to it.
    """

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return "path string, content string, n_bytes bigint"

    def reader(self, schema):
        return _SavedReader(self.options)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _SavedReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.glob, self.charset = options["path"], options.get("glob", "*"), options.get("charset")

    def partitions(self):
        return [_File(str(p)) for p in sorted(Path(self.folder.removeprefix("file://")).rglob(self.glob)) if p.is_file()] or [_File("")]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition.path:
            raw = Path(partition.path).read_bytes()
            yield pa.RecordBatch.from_pydict({"path": [partition.path], "content": [decode(raw, self.charset)], "n_bytes": pa.array([len(raw)], pa.int64())})


def read_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Job files (YAML) of a folder as rows, with the defaults of absent settings."""
    import json

    import yaml

    schema = "job_id string, job_name string, category string, target_db string, target_table string, collector_type string, adapter string, priority int, enabled boolean, phase string, schedule string, max_pages int, max_depth int, concurrency int, rate_limit double, config_json string, status string"
    defaults = {"priority": 50, "enabled": True, "phase": "bootstrap", "schedule": "@hourly", "max_pages": 200, "max_depth": 3, "concurrency": 2, "rate_limit": 1.0, "status": "idle"}
    names = [f.split()[0] for f in schema.split(", ")]
    rows = []
    for p in sorted([*Path(folder).glob("*.yaml"), *Path(folder).glob("*.yml")]):
        job = defaults | (yaml.safe_load(p.read_text(encoding="utf-8")) or {})
        job["config_json"] = json.dumps(job.pop("config", {}) or {}, ensure_ascii=False)
        job["rate_limit"] = float(job["rate_limit"])
        rows.append(tuple(job.get(n) for n in names))
    return spark.createDataFrame(rows, schema)
