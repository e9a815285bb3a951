"""Records that are identical except for formatting, collapsed and counted.

Each record gets a canonical form without white space, letter case, punctuation
and the order of keys or parameters. Every partition fills two Bloom filters
with the hashes of these forms: *once* for those met, *again* for those met twice.
The filters have BITS_PER_ROW bits for each row of the input, so they do not fill
up however many rows there are; they are cut into chunks, a partition sends only
the bits it sets, and the chunks of all partitions merge in parallel as
``again |= a.again | (once & a.once)`` and ``once |= a.once``, which can only add
to *again*. *Again* holds repeats alone, so it is folded to a size that suits
their number (at most MAX_BITS) before it is broadcast. Records whose hash is not
in it are singletons and are never shuffled; the others are shuffled and grouped
exactly, so a filter that is too full costs time but changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pairs_of_groups, ship

#: Bits of the broadcast filter, at most (64 MB).
MAX_BITS = 1 << 29
#: Bits a row when the filters are built (only set bits are sent), and bits kept for each set one when they are folded.
BITS_PER_ROW = 32
BITS_PER_SET = 3
CHUNK_BITS = 1 << 16
PROBES = 4


def plain(c: Column) -> Column:
    """Text without white space, case, punctuation and symbols; null stays null."""
    return F.lower(F.regexp_replace(c, r"[\p{P}\p{S}\p{Z}\p{Cc}]+", ""))


def plain_url(c: Column) -> Column:
    """As ``plain``, with the parameters after ``?`` in order of their text."""
    c = F.trim(c)
    query = F.regexp_extract(c, r"\?([^#]*)", 1)
    params = F.array_join(F.array_sort(F.transform(F.split(query, "[&;]"), plain)), "&")
    return F.when(c.contains("?"), F.concat_ws("?", plain(F.regexp_replace(c, r"\?[^#]*", "")), params)).otherwise(plain(c))


def plain_json(c: Column) -> Column:
    """As ``plain``, with the keys of every object in order; text that is no JSON as it stands."""
    return plain(F.coalesce(F.to_json(F.try_parse_json(c)), c))


def canonical(df: DataFrame, texts: list[str], urls: list[str] = [], jsons: list[str] = [], scope: list[str] = []) -> Column:  # noqa: B006
    """Canonical form of a record; null and blank differ, as one is no text."""
    parts = [F.col(s).cast("string") for s in scope] + [plain(F.col(t)) for t in texts] + [plain_url(F.col(u)) for u in urls] + [plain_json(F.col(j)) for j in jsons]
    return F.concat_ws("\x1f", *(F.coalesce(p, F.lit("\x00")) for p in parts))


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES positions for each 64-bit hash; those of a smaller filter are the same modulo its size."""
    h = h.astype(np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return np.stack([((h + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(PROBES)])


def _test(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def _chunks(at: np.ndarray, width: int) -> tuple[np.ndarray, list[bytes]]:
    """Sorted distinct positions as (chunk numbers, places within each as packed uint16)."""
    at = np.unique(at)
    chunk, first = np.unique(at // width, return_index=True)
    low = (at % width).astype(np.uint16)
    return chunk, [x.tobytes() for x in np.split(low, first[1:])]


def repeat_filter(hashes: DataFrame, bits: int, max_bits: int) -> tuple[bytes, int]:
    """The merged *again* bitmap of a one-column DataFrame of 64-bit hashes, and its size.

    It is built in ``bits`` bits and folded to at most ``max_bits``.
    """
    width = min(CHUNK_BITS, bits)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]  # 8 bytes a row of the partition
        if not own:
            return
        h, n = np.unique(np.concatenate(own), return_counts=True)
        chunk, once = _chunks(_slots(h, bits).ravel(), width)
        twice = dict(zip(*(x if isinstance(x, list) else x.tolist() for x in _chunks(_slots(h[n > 1], bits).ravel(), width)))) if (n > 1).any() else {}
        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(once, pa.binary()), pa.array([twice.get(c, b"") for c in chunk.tolist()], pa.binary())], names=["chunk", "once", "again"])

    def merge(t: pa.Table) -> pa.Table:
        once, again = np.zeros(width, bool), np.zeros(width, bool)
        for o, a in zip(t.column("once").to_pylist(), t.column("again").to_pylist()):
            at = np.frombuffer(o, np.uint16)
            again[at[once[at]]] = True
            once[at] = True
            again[np.frombuffer(a, np.uint16)] = True
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "n": pa.array([int(again.sum())], pa.int64()), "again": pa.array([np.packbits(again, bitorder="little").tobytes()], pa.binary())})

    merged = cut(hashes.mapInArrow(fill, "chunk bigint, once binary, again binary").groupBy("chunk").applyInArrow(merge, "chunk bigint, n bigint, again binary").where("n > 0"))
    marked = merged.agg(F.sum("n").alias("n")).first().n or 0
    size = min(bits, max(width, min(1 << (max_bits.bit_length() - 1), 1 << (BITS_PER_SET * marked).bit_length())))
    folds = size // width

    def fold(t: pa.Table) -> pa.Table:
        out = np.zeros(width // 8, np.uint8)
        for a in t.column("again").to_pylist():
            out |= np.frombuffer(a, np.uint8)
        return pa.table({"part": t.column("part").slice(0, 1), "again": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    for row in merged.select((F.col("chunk") % folds).alias("part"), "again").groupBy("part").applyInArrow(fold, "part bigint, again binary").collect():  # at most size/8 bytes in all
        out[row.part * width // 8 : (row.part + 1) * width // 8] = np.frombuffer(bytes(row.again), np.uint8)
    return out.tobytes(), size


def mark_repeats(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Adds ``maybe``: false for rows whose ``form`` surely occurs once.

    ``rows`` must have a string column ``form``; it is read twice.
    """
    spark = rows.sparkSession
    ship(spark)
    hashed = rows.withColumn("_h", F.xxhash64("form"))
    bitmap, bits = repeat_filter(hashed.select("_h"), 1 << max(16, int(BITS_PER_ROW * rows.count()).bit_length()), max(max_bits, 1 << 16))
    again = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(_test(np.frombuffer(again.value, np.uint8), _slots(h.to_numpy(), bits)))

    return hashed.withColumn("maybe", maybe("_h")).drop("_h")


def collapse(df: DataFrame, id_col: str, texts: list[str], urls: list[str] = [], jsons: list[str] = [], scope: list[str] = [], max_bits: int = MAX_BITS) -> DataFrame:  # noqa: B006
    """One row (id of the first copy, ``n_copies``) per canonical form.

    Counts every copy, exact ones included. Null differs from blank, null ids
    come last; empty table, no rows; other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("_id"), canonical(df, texts, urls, jsons, scope).alias("form"))
    marked = mark_repeats(rows, max_bits)
    many = marked.where("maybe").groupBy("form").agg(F.min("_id").alias(id_col), F.count("*").alias("n_copies")).select(id_col, "n_copies")
    return many.unionByName(marked.where("not maybe").select(F.col("_id").alias(id_col), F.lit(1).cast("bigint").alias("n_copies")))


def copy_pairs(df: DataFrame, id_col: str, texts: list[str], urls: list[str] = [], jsons: list[str] = [], scope: list[str] = [], max_bits: int = MAX_BITS) -> DataFrame:  # noqa: B006
    """Pairs (id_a < id_b) of records with one canonical form."""
    rows = df.select(F.col(id_col).alias("_id"), canonical(df, texts, urls, jsons, scope).alias("form"))
    kept = cut(mark_repeats(rows, max_bits).where("maybe").select("_id", "form"))
    return pairs_of_groups(kept, ["form"], "_id").select("id_a", "id_b")
