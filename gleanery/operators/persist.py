"""From extracted records to what is stored: checks, resolution, the action taken and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..functions.urls import is_http
from .resolve import evidence, resolve, with_fingerprint

#: What each action means for the candidate, the reviews and the run's counters.
ROUTES = {
    "skip": ("rejected", None, ["rejected"]), "invalid": ("review", "parse_failure", ["reviewed"]), "inserted": ("accepted", None, ["inserted"]),
    "updated": ("duplicate", None, ["updated", "duplicates"]), "review": ("review", "duplicate_ambiguity", ["reviewed"]),
}
COUNTERS = ["inserted", "updated", "duplicates", "reviewed", "rejected"]
#: Actions that leave evidence.
STORED = ("inserted", "updated")


def checks(df: DataFrame, required: list[str], fields: str = "fields_json") -> tuple[Column, Column]:
    """(errors, warnings): ordered, distinct codes of a record with ``missing_required`` and JSON ``fields``.

    A required name that is no column is looked for among the fields. Type rules
    of columns cannot fail in a typed table; those of ``fields`` can: text that is
    no JSON object is ``invalid_type:fields``, a blank key ``invalid_fields_key``.
    """
    kinds = dict(df.dtypes)
    map_ = F.from_json(F.when(F.try_parse_json(fields).isNotNull() & F.ltrim(fields).startswith("{"), F.col(fields)), "map<string,string>")
    known = F.create_map(*(x for c in df.columns if kinds[c] in ("string", "double", "boolean") for x in (F.lit(c), F.col(c).cast("string"))))
    names = F.array_distinct(F.concat(F.array(*map(F.lit, required)).cast("array<string>"), F.coalesce("missing_required", F.array().cast("array<string>"))))
    value = lambda r: F.when(F.map_contains_key(known, r), F.element_at(known, r)).otherwise(F.element_at(F.coalesce(map_, F.create_map().cast("map<string,string>")), r))
    missing = F.transform(F.filter(names, lambda r: is_blank(value(r))), lambda r: F.concat(F.lit("missing_required:"), r))
    rules = [
        F.when(map_.isNull(), F.lit("invalid_type:fields")),
        F.when(F.col("confidence").isNull(), F.lit("invalid_type:confidence")).when(~F.col("confidence").between(0.0, 1.0), F.lit("invalid_range:confidence")),
        F.when(~is_blank(F.col("canonical_url")) & ~is_http(F.col("canonical_url")), F.lit("invalid_url:canonical_url")),
        F.when(F.exists(F.map_keys(map_), is_blank), F.lit("invalid_fields_key")),
    ]
    skip = F.coalesce("is_skip", F.lit(False))
    errors = F.when(skip, F.array(F.lit("record_marked_skip"))).otherwise(F.array_distinct(F.concat(missing, F.array_compact(F.array(*rules)))))
    derivable = ~skip & ~is_blank(F.col("canonical_url")) & is_blank(F.col("domain"))
    return errors, F.when(derivable, F.array(F.lit("domain_missing_but_derivable"))).otherwise(F.array().cast("array<string>"))


def persisted(records: DataFrame, entities: DataFrame, required: list[str]) -> DataFrame:
    """Adds ``action`` (skip, invalid, review, inserted, updated), ``entity_id``, ``reason`` and ``errors`` to each record.

    Records have a normalized_name; those skipped or invalid are not resolved. A
    record without a link takes ``source_url`` where there is such a column.
    """
    if "source_url" in records.columns:
        records = records.withColumn("canonical_url", F.when(is_blank(F.col("canonical_url")), F.col("source_url")).otherwise(F.col("canonical_url")))
    errors, _ = checks(records, required)
    checked = with_fingerprint(records.withColumn("errors", errors))
    bad = F.size("errors") > 0
    found = resolve(checked.where(~bad).drop("entity_id"), entities)
    good = found.withColumn("action", F.when(F.col("action") == "merge", "updated").when(F.col("action") == "new", "inserted").otherwise(F.col("action")))
    skip = F.coalesce("is_skip", F.lit(False))
    rest = checked.where(bad).drop("entity_id").withColumns({"action": F.when(skip, "skip").otherwise("invalid"), "entity_id": F.lit(None).cast("string"), "reason": F.when(skip, F.col("skip_reason")).otherwise(F.array_join("errors", ","))})
    return good.unionByName(rest)


def routed(rows: DataFrame) -> DataFrame:
    """Adds ``candidate_status``, ``review_reason`` and the counters an action stands for."""
    pick = lambda k: F.coalesce(*(F.when(F.col("action") == a, F.lit(r[k])) for a, r in ROUTES.items()))
    lacking = (F.col("action") == "invalid") & F.exists("errors", lambda e: e.startswith("missing_required:"))
    counters = {c: F.coalesce(F.col("action").isin([a for a, r in ROUTES.items() if c in r[2]]).cast("int"), F.lit(0)) for c in COUNTERS}
    return rows.withColumns({"candidate_status": pick(0), "review_reason": F.when(lacking, "missing_required_field").otherwise(pick(1)), **counters})


def outcome_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of routed rows per key; every record is a fetched one too."""
    return rows.groupBy(*keys).agg(F.count("*").alias("fetched"), *(F.sum(c).alias(c) for c in COUNTERS))


def stored_evidence(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Evidence of the records that were inserted or merged, of no others."""
    return evidence(rows.where(F.col("action").isin(*STORED)), keep)
