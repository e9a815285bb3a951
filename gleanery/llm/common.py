"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder of this machine serves a local session only; on a
    cluster that would break silently, so it is an error there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        where = f"file://{tempfile.gettempdir()}/gleanery-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: the lineage ends in files that outlive an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


#: Rows of one key that one task may pair with the key's other rows.
HOT_ROWS = 20_000
#: Slices of a key's rows when its size is looked up.
SLICES = 64


def pairs_of_groups(rows: DataFrame, keys: list[str], id_col: str, differs: str | None = None, carry: str | None = None) -> DataFrame:
    """Pairs (``keys``, id_a < id_b) of rows with equal keys, each once.

    ``differs`` names a column whose values must differ within a pair, ``carry``
    one that comes along as ``<carry>_a`` and ``<carry>_b``; it must follow from the
    id. A key with more than HOT_ROWS rows is salted: its left side is spread over
    n/HOT_ROWS tasks, its right side goes to each of them. Keys with one row are
    dropped before any row is paired; sizes come back to the rows by a join on the
    key and a slice of the id, so a hot key is no single task there either.
    ``rows`` is used three times, so it should be a table or checkpoint. Null keys
    pair with nothing; rows that agree in keys, id and ``differs`` count once.
    """
    from pyspark.sql import functions as F

    cols = [*keys, id_col, *([differs] if differs else [])]
    rows = rows.select(*cols, *([carry] if carry else [])).dropDuplicates(cols)
    slices = rows.groupBy(*keys, F.expr(f"cast(pmod(xxhash64({id_col}), {SLICES}) as int)").alias("_p")).agg(F.count("*").alias("_n"))
    sizes = slices.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.collect_list("_p").alias("_p")).where("_n > 1").select(*keys, "_n", F.explode("_p").alias("_p"))
    rows = rows.withColumn("_p", F.expr(f"cast(pmod(xxhash64({id_col}), {SLICES}) as int)")).join(sizes, [*keys, "_p"]).withColumn("_s", F.ceil(F.col("_n") / HOT_ROWS).cast("int"))
    more = lambda side: ([F.col(differs).alias(f"_d{side}")] if differs else []) + ([F.col(carry).alias(f"{carry}_{side}")] if carry else [])
    a = rows.select(*keys, F.col(id_col).alias("_a"), *more("a"), F.expr(f"cast(pmod(xxhash64({id_col}, 7), _s) as int)").alias("_salt"))
    b = rows.select(*keys, F.col(id_col).alias("_b"), *more("b"), F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("_salt"))
    both = a.join(b, [*keys, "_salt"]).where(F.col("_a") < F.col("_b"))
    if differs:
        both = both.where(F.col("_da") != F.col("_db")).dropDuplicates([*keys, "_a", "_b"])
    return both.select(*keys, F.col("_a").alias("id_a"), F.col("_b").alias("id_b"), *([f"{carry}_a", f"{carry}_b"] if carry else []))
