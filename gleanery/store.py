"""Versioned Parquet tables: a write makes new files, then one numbered manifest that lists what the version holds."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Tables under one folder that all executors share.

    A version is a manifest; the one with the highest number is in force. It is
    written under a name of its own and renamed, so a reader sees the old version
    or the new one, and a writer that dies in between leaves the old one. One
    writer per table is assumed; a second one fails at the rename. Files that none
    of the last ``keep`` manifests lists are removed by the next write.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, table: str) -> list[str]:
        at = self.path(f"{self.root}/{table}")
        return [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def versions(self, table: str) -> list[int]:
        return sorted(int(m[1]) for n in self._names(table) if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))

    def _parts(self, table: str, version: int) -> list[str]:
        stream = self.fs.open(self.path(f"{self.root}/{table}/manifest-{version:09d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"]
        finally:
            stream.close()

    def exists(self, table: str) -> bool:
        return bool(self.versions(table))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        known = self.versions(table)
        if not known or version is not None and version not in known:
            raise KeyError(f"no table {table!r} (version {version}) under {self.root}")
        return self.spark.read.parquet(*(f"{self.root}/{table}/{p}" for p in self._parts(table, known[-1] if version is None else version)))

    def _add(self, table: str, df: DataFrame, before: list[str], partition_by: list[str]) -> int:
        part = f"v-{uuid.uuid4().hex}"
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(f"{self.root}/{table}/{part}")
        return self.commit(table, [*before, part])

    def commit(self, table: str, parts: list[str]) -> int:
        """Makes ``parts`` the next version."""
        version = max(self.versions(table), default=0) + 1
        draft = self.path(f"{self.root}/{table}/_draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps({"parts": parts}).encode()))
        out.close()
        if not self.fs.rename(draft, self.path(f"{self.root}/{table}/manifest-{version:09d}.json")):
            raise RuntimeError(f"another writer has made version {version} of {table!r}")
        self._drop_old(table)
        return version

    def write(self, table: str, df: DataFrame, partition_by: list[str] = ()) -> int:
        """A new version of these rows alone."""
        return self._add(table, df, [], list(partition_by))

    def update(self, table: str, change: Callable[[DataFrame], DataFrame]) -> int:
        """A new version from the current one, which stays readable meanwhile."""
        return self.write(table, change(self.read(table)))

    def append(self, table: str, df: DataFrame, partition_by: list[str] = ()) -> int:
        """A new version of the current files and these rows; nothing stored is written again."""
        known = self.versions(table)
        return self._add(table, df, self._parts(table, known[-1]) if known else [], list(partition_by))

    def compact(self, table: str, files: int) -> int:
        """The same rows in ``files`` files."""
        return self.write(table, self.read(table).repartition(files))

    def _drop_old(self, table: str) -> None:
        known = self.versions(table)
        used = {p for v in known[-self.keep :] for p in self._parts(table, v)}
        old = {p for v in known[: -self.keep] for p in self._parts(table, v)} - used
        for v in known[: -self.keep]:
            self.fs.delete(self.path(f"{self.root}/{table}/manifest-{v:09d}.json"), False)
        for p in old:
            self.fs.delete(self.path(f"{self.root}/{table}/{p}"), True)
