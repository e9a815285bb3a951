"""Counts, windows over run histories, and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def with_counts(base: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """``base`` with, for every named part, its number of rows per key, 0 where it has none."""
    for name, df in parts.items():
        base = base.join(counts(df, [key], name), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return base


def http_buckets(df: DataFrame, keys: list[str]) -> DataFrame:
    """Answers by hundreds, those that matter for politeness, and how many have no status."""
    s = F.col("http_status")
    rng = {f"http_{k}xx": s.between(k * 100, k * 100 + 99) for k in (2, 3, 4, 5)}
    one = {f"http_{k}": s == k for k in (403, 404, 429)}
    return df.groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in (rng | one).items()), F.count_if(s.isNull()).alias("no_status"), F.count("*").alias("fetches"))


def error_rate(errors: Column, total: Column) -> Column:
    """Share of errors, 0 where nothing was done."""
    return F.coalesce(F.try_divide(errors.cast("double"), total.cast("double")), F.lit(0.0))


def saturation(runs: DataFrame, key: str, order: str, last: int = 5, least: int = 3, rate: float = 0.05) -> DataFrame:
    """Adds, to runs with ``total`` and ``fresh``, the share of fresh ones, whether the last runs were all
    low, and the length of the current streak of low runs. A run without any total is low but never saturated."""
    w = Window.partitionBy(key).orderBy(order)
    tail = w.rowsBetween(-(last - 1), 0)
    out = runs.withColumn("rate", error_rate(F.col("fresh"), F.col("total"))).withColumn("low", (F.col("rate") <= rate).cast("int"))
    out = out.withColumn("saturated", (F.count("*").over(tail) >= least) & (F.min("total").over(tail) > 0) & (F.min("low").over(tail) == 1))
    out = out.withColumn("_island", F.sum(1 - F.col("low")).over(w))
    return out.withColumn("low_streak", F.sum("low").over(Window.partitionBy(key, "_island").orderBy(order))).drop("_island")


def after_first(df: DataFrame, key: str, order: list[Column | str], k: int) -> DataFrame:
    """Rows of each key after its first ``k``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") > k).drop("_n")


def broken_rules(tables: dict[str, DataFrame], rules: list[tuple[str, str, Column]], unique: list[tuple[str, list[str]]], refs: list[tuple[str, str, str, str]]) -> DataFrame:
    """(rule, broken): rows against value rules, repeated keys, and references that lead nowhere."""
    parts = [tables[t].agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("broken")).select(F.lit(name).alias("rule"), "broken") for name, t, ok in rules]
    for t, keys in unique:
        parts.append(tables[t].groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("broken")).select(F.lit(f"unique:{t}({','.join(keys)})").alias("rule"), "broken"))
    for t, c, to, key in refs:
        lost = tables[t].where(F.col(c).isNotNull()).join(tables[to].select(F.col(key).alias(c)).distinct(), c, "left_anti")
        parts.append(lost.agg(F.count("*").alias("broken")).select(F.lit(f"reference:{t}.{c}").alias("rule"), "broken"))
    return reduce(DataFrame.unionByName, parts)
