"""Checking each new batch against everything accepted, without redoing history.

Multi-key sorted-neighbourhood runs. Every record has sort keys: its job with its
listing number, or, where no number can be read, its job with its cleaned link
and with its fingerprint. The store keeps *runs*: Parquet files in ranges of the
keys' own order, sorted within each, listed by numbered manifests, so a store can
be opened again by any later session and a writer that dies leaves the last
manifest in force. A batch is reduced to its distinct keys, sorted, and dealt to
the key ranges; each range's task merges its part with the stored runs, opening
only the row groups whose keys reach into the windows around new keys. History is
never shuffled or sorted again. In a window, a record that stands at the same key
is a repeat; keys of links and fingerprints are also compared with the WINDOW
nearest keys on either side, stored or of the batch, as near-duplicates (``near``);
numbers are compared for equality alone, as other numbers are other listings.
Unseen keys become a new run; FAN runs of one level are merged into one of the
next, so a key is rewritten a few times, not with every batch. A key is stored
once, with its first holder, so windows do not grow with the number of copies.
"""

from __future__ import annotations

import json
import re
import uuid
from bisect import bisect_left, bisect_right
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICES, cut, shared_dir, ship

#: Runs of one level that are merged into one of the next.
FAN = 4
#: Level of the first run; it is rewritten only when the ranges are drawn again.
BASE = 99
ROWS_PER_RANGE = 500_000
#: Boundaries of key ranges, at most, and keys sampled for each; both only say where ranges end.
MAX_RANGES, SAMPLE = 4096, 16
#: Bytes of a row group, the least that is read of a run.
GROUP_BYTES = 1 << 20
#: Neighbours on either side a link or fingerprint is compared with.
WINDOW = 5
# Parameters that never name a listing.
TRACKING = "utm_[a-z]+|fbclid|gclid|ref|referrer|from|src"


def listing_number(url: Column) -> Column:
    """The number a link leads to, without leading zeros; null if it has none.

    Host, fragment and tracking parameters are no part of it, nor are runs of
    fewer than six digits.
    """
    rest = F.regexp_replace(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"#.*$", ""), rf"(?<=[?&])(?:{TRACKING})=[^&]*", "")
    return F.nullif(F.regexp_extract(rest, r"(?<![0-9])0*([1-9][0-9]{5,})(?![0-9])", 1), F.lit(""))


def plain_link(url: Column) -> Column:
    """Link without scheme, host prefixes, fragment, tracking and closing slash, parameters in order."""
    x = F.regexp_replace(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:m\.|www\.)*", "")
    x = F.regexp_replace(F.regexp_replace(x, r"#.*$", ""), rf"(?<=[?&])(?:{TRACKING})=[^&]*&?", "")
    x = F.regexp_replace(x, r"[/?&]+$", "")
    query = F.array_join(F.array_sort(F.split(F.regexp_extract(x, r"\?(.*)$", 1), "&")), "&")
    return F.nullif(F.when(x.contains("?"), F.concat_ws("?", F.regexp_replace(x, r"\?.*$", ""), query)).otherwise(x), F.lit(""))


def sort_keys(job: Column, number: Column, link: Column, fingerprint: Column) -> Column:
    """Array of the record's sort keys; records with a number have that key alone."""
    named = F.concat_ws("|", F.lit("n"), job, number)
    others = F.array_compact(F.array(F.when(link.isNotNull(), F.concat_ws("|", F.lit("u"), job, link)), F.when(fingerprint.isNotNull(), F.concat_ws("|", F.lit("f"), job, fingerprint))))
    return F.when(number.isNotNull(), F.array(named)).otherwise(others)


def near(a: str, b: str) -> bool:
    """Whether two keys of links or fingerprints are near-duplicates: of one kind and job, and one letter apart.

    A letter added, lost or changed; digits must agree, as they tell pages apart,
    and so must short keys (under 12 characters after the job).
    """
    if a[:1] != b[:1] or abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[k] != b[k]), n)
    k = 0
    while k < n - i and a[-1 - k] == b[-1 - k]:
        k += 1
    x, y = a[i : len(a) - k], b[i : len(b) - k]
    job = a.find("|", 2)
    return len(x) < 2 and len(y) < 2 and i > job > 0 and n - job > 12 and not any(c.isdigit() or c == "|" for c in x + y)


class RunStore:
    """Persisted runs of (key, holder) in key ranges. One writer at a time is assumed."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
        ship(spark)
        self._of = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.version, self.bounds, self.runs = 0, [], []
        known = self._manifests()
        if known:
            self.version = known[-1]
            stream = self._fs.open(self._of(self._manifest(self.version)))
            try:
                state = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            self.bounds, self.runs = state["bounds"], state["runs"]

    def _manifest(self, n: int) -> str:
        return f"{self.path}/manifest-{n:09d}.json"

    def _manifests(self) -> list[int]:
        if not self._fs.exists(self._of(self.path)):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(self._of(self.path)))
        return sorted(int(m[1]) for x in names if (m := re.fullmatch(r"manifest-(\d+)\.json", x)))

    def _commit(self) -> None:
        """Writes the next manifest under a name of its own, then renames it; runs no longer listed go with the manifest before the last."""
        self.version += 1
        draft, at = self._of(f"{self.path}/_draft-{uuid.uuid4().hex}"), self._of(self._manifest(self.version))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"bounds": self.bounds, "runs": self.runs}).encode()))
        out.close()
        if not self._fs.rename(draft, at):
            raise RuntimeError(f"another writer has made version {self.version} of {self.path}")
        for n in self._manifests()[:-2]:
            self._fs.delete(self._of(self._manifest(n)), False)

    @property
    def rows(self) -> int:
        return sum(r["rows"] for r in self.runs)

    def plan(self, keys: DataFrame, n_keys: int) -> None:
        """Boundaries of the key ranges: quantiles of a bounded sample of the keys, in their own order."""
        n = max(1, min(MAX_RANGES, -(-n_keys // ROWS_PER_RANGE)))
        self.bounds = []
        if n > 1:
            step = max(1, n_keys // (n * SAMPLE))
            marks = sorted(r.key for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).select("key").limit(4 * n * SAMPLE).collect())
            self.bounds = sorted({marks[len(marks) * i // n] for i in range(1, n)}) if marks else []

    def ranged(self, keys: DataFrame) -> DataFrame:
        """Adds ``range``; never a literal, as the sort of a run by a constant and its key would be dropped."""
        bounds = self.bounds

        @F.pandas_udf("int")
        def range_of(k: pd.Series) -> pd.Series:
            return k.map(lambda x: bisect_right(bounds, x))

        return keys.withColumn("range", range_of("key"))

    def append(self, keys: DataFrame, n: int, level: int = 0, drop: list[str] = ()) -> None:
        """Writes ``n`` rows (key, holder) as one more sorted run, in place of the runs ``drop``."""
        run = f"{self.path}/run-{uuid.uuid4().hex}"
        rows = self.ranged(keys.select("key", "holder"))
        rows.repartition(max(1, min(len(self.bounds) + 1, 256)), "range").sortWithinPartitions("range", "key").write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.row.count.limit", 2000).partitionBy("range").parquet(run)
        self.runs = [r for r in self.runs if r["path"] not in drop] + ([{"path": run, "level": level, "rows": n}] if n else [])
        self._commit()
        for old in drop:
            self._fs.delete(self._of(old), True)

    def read(self, paths: list[str] | None = None) -> DataFrame:
        frames = [self.spark.read.schema("key string, holder string, range int").parquet(r) for r in (paths if paths is not None else [r["path"] for r in self.runs])]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], "key string, holder string, range int")

    def prepare(self, keys: DataFrame, n_keys: int) -> None:
        """Draws the ranges again where stored and new keys have outgrown them."""
        n = self.rows + n_keys
        if n > 2 * ROWS_PER_RANGE * (len(self.bounds) + 1) and len(self.bounds) + 1 < MAX_RANGES:
            both = self.read().select("key").unionByName(keys.select("key"))
            old, rows = [r["path"] for r in self.runs], self.read().select("key", "holder")
            self.plan(both, n)
            if old:
                self.append(rows, self.rows, BASE, old)

    def windows(self, new: DataFrame) -> DataFrame:
        """(key, exact, holder, peer, groups_read) for distinct new keys (key, first: struct of rank and id).

        ``exact`` says the key is stored; ``holder`` is its holder, else that of a
        near-duplicate in the window; ``peer`` the earliest record of a near-duplicate
        key of the batch itself, if that is earlier than the key's own.
        """
        runs = [re.sub(r"^file:/+", "/", r["path"]) for r in self.runs]

        def merge(t: pa.Table) -> pa.Table:
            rows = sorted(zip(t.column("key").to_pylist(), t.column("rank").to_pylist(), t.column("id").to_pylist()))
            keys = [r[0] for r in rows]
            exact, close = [None] * len(keys), [None] * len(keys)
            read = 0
            for run in runs:
                fs, at = pyarrow.fs.FileSystem.from_uri(f"{run}/range={t.column('range')[0].as_py()}")
                for f in fs.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True)):
                    if not f.path.endswith(".parquet"):
                        continue
                    with fs.open_input_file(f.path) as source:
                        file = pq.ParquetFile(source)
                        spans = [file.metadata.row_group(g).column(0).statistics for g in range(file.metadata.num_row_groups)]
                        if all(s is not None and s.has_min_max for s in spans):
                            need = {g for g, s in enumerate(spans) if bisect_left(keys, s.min) < bisect_right(keys, s.max)}
                            least = [s.min for s in spans]
                            for key in keys:
                                if key[0] != "n":  # its window may reach over the edge of a row group
                                    g = bisect_right(least, key) - 1
                                    need |= {x for x in (g - 1, g, g + 1) if 0 <= x < len(spans)}
                        else:
                            need = set(range(len(spans)))
                        if not need:
                            continue
                        read += len(need)
                        part = file.read_row_groups(sorted(need), columns=["key", "holder"])
                    stored, holders = part.column(0).to_pylist(), part.column(1).to_pylist()
                    lo, hi = (bisect_left(keys, stored[0]), bisect_right(keys, stored[-1])) if keys[0][0] == "n" and keys[-1][0] == "n" else (0, len(keys))
                    p = 0
                    for k in range(lo, hi):
                        key = keys[k]
                        p = bisect_left(stored, key, p)
                        if p < len(stored) and stored[p] == key:
                            exact[k] = holders[p]
                        elif key[0] != "n" and exact[k] is None:
                            for q in range(max(0, p - WINDOW), min(len(stored), p + WINDOW)):
                                if near(key, stored[q]) and (close[k] is None or holders[q] < close[k]):
                                    close[k] = holders[q]
            peer = [None] * len(keys)
            for k, key in enumerate(keys):
                if key[0] != "n" and exact[k] is None:
                    own = rows[k][1:]
                    best = min((rows[q][1:] for q in range(max(0, k - WINDOW), min(len(keys), k + WINDOW + 1)) if q != k and near(key, keys[q])), default=own)
                    peer[k] = best[1] if best < own else None
            return pa.table({"key": pa.array(keys, pa.string()), "exact": pa.array([x is not None for x in exact], pa.bool_()), "holder": pa.array([x if x is not None else y for x, y in zip(exact, close)], pa.string()), "peer": pa.array(peer, pa.string()), "groups_read": pa.array([read] * len(keys), pa.int32())})

        rows = self.ranged(new.select("key", F.col("first.rank").alias("rank"), F.col("first.id").alias("id")))
        return rows.groupBy("range").applyInArrow(merge, "key string, exact boolean, holder string, peer string, groups_read int")

    def compact(self) -> None:
        """Merges the runs of a level once there are FAN of them."""
        level = 0
        while len(full := [r["path"] for r in self.runs if r["level"] == level]) >= FAN:
            self.append(self.read(full), sum(r["rows"] for r in self.runs if r["level"] == level), level + 1, full)
            level += 1


def ingest(store: RunStore, batch: DataFrame) -> DataFrame:
    """Resolves one batch of (id, keys, rank) and stores its unseen keys.

    Returns (id, holder): the record each repeats, or null if it is new. A
    record matching by several keys takes the stored holder first, then the
    batch's first by (``rank``, ``id``). Records without any key are new. Rows
    repeated under one id count once. A key many records share is taken in slices.
    """
    batch = batch.dropDuplicates(["id"])
    keyed = batch.select("id", "rank", F.explode("keys").alias("key"), F.pmod(F.hash("id"), F.lit(SLICES)).alias("slice"))
    slices = keyed.groupBy("key", "slice").agg(F.min(F.struct("rank", "id")).alias("first"))
    new = cut(slices.groupBy("key").agg(F.min("first").alias("first"), F.collect_list("slice").alias("slices")))  # at most SLICES
    n_new = new.count()
    store.prepare(new, n_new)
    per_key = cut(new.join(store.windows(new), "key"))
    n_unseen = per_key.where("not exact").count()
    unseen = per_key.where("not exact").select("key", F.coalesce("holder", "peer", "first.id").alias("holder"))
    known = per_key.select("key", "holder", F.coalesce("peer", "first.id").alias("earliest"), F.explode("slices").alias("slice"))
    out = keyed.join(known, ["key", "slice"]).groupBy("id").agg(F.min("holder").alias("stored"), F.min(F.when(F.col("earliest") != F.col("id"), F.col("earliest"))).alias("earlier"))
    out = out.select("id", F.coalesce("stored", "earlier").alias("holder")).unionByName(batch.where("coalesce(size(keys), 0) = 0").select("id", F.lit(None).cast("string").alias("holder")))
    store.append(unseen, n_unseen)
    store.compact()
    return out


def repeats(candidates: DataFrame, entities: DataFrame, discovered: DataFrame) -> DataFrame:
    """Pairs (id_a < id_b): each candidate that repeats something, with what it repeats.

    That is the smallest entity of the same job and listing, else the first
    candidate for it by (batch_no, candidate_id). Batches are taken in order of
    batch_no; null batches come last. Blank links and numbers are null.
    """
    spark = candidates.sparkSession
    number_of = lambda fp: F.nullif(F.regexp_extract(fp, r"^[^:/]+:0*([1-9][0-9]{5,})$", 1), F.lit(""))
    c = candidates.select("candidate_id", "job_id", "batch_no", "url", F.col("fingerprint").alias("fp")).withColumn("number", F.coalesce(listing_number(F.col("url")), number_of(F.col("fp"))))
    # Only candidates without a number of their own ask the discovery log for its stable id.
    d = discovered.where("stable_id is not null").select("job_id", "batch_no", "url", F.regexp_extract("stable_id", r"^0*([1-9][0-9]{5,})$", 1).alias("stable")).where("stable != ''").groupBy("job_id", "batch_no", "url").agg(F.min("stable").alias("stable"))
    c = c.join(d, ["job_id", "batch_no", "url"], "left").withColumn("number", F.coalesce("number", "stable"))
    arrivals = c.select(F.col("candidate_id").alias("id"), F.coalesce("batch_no", F.lit(2**31 - 1)).alias("rank"), sort_keys(F.col("job_id"), F.col("number"), plain_link(F.col("url")), F.col("fp")).alias("keys"))
    e = entities.select("entity_id", "job_id", F.coalesce(F.nullif(F.regexp_extract("external_id", r"^0*([1-9][0-9]{5,})$", 1), F.lit("")), listing_number(F.col("canonical_url"))).alias("number"), F.col("canonical_url").alias("url"), (F.col("fingerprint") if "fingerprint" in entities.columns else F.lit(None).cast("string")).alias("fp"))
    # A fingerprint without a number is a key of its own, for candidates that have no number either.
    by_fp = F.when(F.col("fp").isNotNull() & number_of(F.col("fp")).isNull() & F.col("number").isNotNull(), F.array(F.concat_ws("|", F.lit("f"), "job_id", "fp"))).otherwise(F.array().cast("array<string>"))
    history = e.select(F.explode(F.concat(sort_keys(F.col("job_id"), F.col("number"), plain_link(F.col("url")), F.col("fp")), by_fp)).alias("key"), "entity_id").groupBy("key").agg(F.min("entity_id").alias("holder"))
    history = cut(history)
    store = RunStore(spark)
    n = history.count()
    store.plan(history, n)
    store.append(history, n, BASE)
    inbox = f"{store.path}/inbox"  # one folder per batch, so a batch reads itself alone
    arrivals.repartition("rank", F.pmod(F.hash("id"), F.lit(8))).write.partitionBy("rank").parquet(inbox)
    batches = spark.read.schema("id string, keys array<string>, rank int").parquet(inbox)
    found = f"{store.path}/found"
    ranks = [r["rank"] for r in batches.select("rank").distinct().orderBy("rank").collect()]  # one row per batch
    if not ranks:
        return spark.createDataFrame([], "id_a string, id_b string")
    for rank in ranks:  # each batch's result is a table of its own, so no plan grows with their number
        got = ingest(store, batches.where(F.col("rank") == rank)).where("holder is not null")
        got.select(F.least("id", "holder").alias("id_a"), F.greatest("id", "holder").alias("id_b")).coalesce(4).write.parquet(f"{found}/batch={rank}")
    return spark.read.schema("id_a string, id_b string, batch int").parquet(found).select("id_a", "id_b")
