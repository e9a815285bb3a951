"""From records to entities: validation, three-way resolution, merge and provenance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import fingerprint
from ..functions.text import is_blank
from ..functions.urls import is_http

#: Columns a merge refreshes with any new value that is not blank.
REFRESHED = ["name", "normalized_name", "canonical_url", "domain", "address", "telephone", "external_id"]


def problems(df: DataFrame, required: list[str]) -> Column:
    """Ordered, distinct codes of what makes a record (with ``missing_required``) unusable."""
    value = {c: F.col(c).cast("string") for c in df.columns}
    fixed = [F.when(is_blank(value[r]) if r in value else F.lit(True), F.lit(f"missing_required:{r}")) for r in required]
    listed = F.transform(F.coalesce("missing_required", F.array().cast("array<string>")), lambda r: F.concat(F.lit("missing_required:"), r))
    named = F.create_map(*(x for c in df.columns if dict(df.dtypes)[c] == "string" for x in (F.lit(f"missing_required:{c}"), is_blank(value[c]))))
    listed = F.filter(listed, lambda code: F.coalesce(F.element_at(named, code), F.lit(True)))
    rules = [
        F.when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), F.lit("invalid_range:confidence")),
        F.when(~is_blank(value["canonical_url"]) & ~is_http(F.col("canonical_url")), F.lit("invalid_url:canonical_url")),
    ]
    found = F.array_distinct(F.concat(F.array_compact(F.array(*fixed)) if fixed else F.array().cast("array<string>"), listed, F.array_compact(F.array(*rules))))
    return F.when(F.coalesce("is_skip", F.lit(False)), F.array(F.lit("record_marked_skip"))).otherwise(found)


def resolve(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds ``action`` (merge, review, new), ``entity_id`` and ``reason`` to each record.

    Both sides have job_id, fingerprint, canonical_url, normalized_name, domain,
    address, telephone. Strong keys come first; a record that found its entity is
    not joined again. Deleted entities never match; of several the smallest id.
    """
    live = entities.where("deleted_at is null")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))

    def by(key: str) -> DataFrame:
        return live.where(filled(key).isNotNull()).groupBy("job_id", F.col(key).alias(f"_{key}")).agg(F.min("entity_id").alias(f"_{key}_hit"))

    # Same name: the smallest entity in conflict, else the smallest. Per name and
    # column two entities decide, the first and the first with another value, so
    # a name that many share is never paired row by row.
    side = ("domain", "address", "telephone")
    named = live.where(filled("normalized_name").isNotNull()).select("job_id", F.col("normalized_name").alias("_normalized_name"), "entity_id", *(filled(c).alias(c) for c in side))
    key = ["job_id", "_normalized_name"]
    firsts = named.groupBy(*key).agg(F.min("entity_id").alias("any_id"), *(F.min(F.when(F.col(c).isNotNull(), F.struct("entity_id", c))).alias(f"_f{c}") for c in side))
    others = named.join(firsts.select(*key, *(F.col(f"_f{c}.{c}").alias(f"_v{c}") for c in side)), key).groupBy(*key).agg(*(F.min(F.when(F.col(c) != F.col(f"_v{c}"), F.col("entity_id"))).alias(f"_o{c}") for c in side))
    names = firsts.join(others, key)
    # A record without a key finds nothing; it is spread over the tasks by its own content.
    own = F.concat(F.lit("\x00"), F.xxhash64(*records.columns).cast("string"))
    rows = records.withColumns({f"_{c}": F.coalesce(filled(c), own) for c in ("fingerprint", "canonical_url", "normalized_name")})
    rows = rows.join(by("fingerprint"), ["job_id", "_fingerprint"], "left").join(by("canonical_url"), ["job_id", "_canonical_url"], "left").join(names, key, "left")
    clash = F.least(*(F.when(filled(c).isNotNull(), F.when(F.col(f"_f{c}.{c}") != F.col(c), F.col(f"_f{c}.entity_id")).otherwise(F.col(f"_o{c}"))) for c in side))
    a, b = F.col("_fingerprint_hit"), F.col("_canonical_url_hit")
    strong = F.coalesce(a, b)
    return rows.withColumn("clash", clash).select(
        *records.columns, F.when(strong.isNotNull(), "merge").when(F.col("any_id").isNull(), "new").otherwise("review").alias("action"), F.coalesce(strong, "clash", "any_id").alias("entity_id"),
        F.when(a.isNotNull(), "fingerprint match").when(b.isNotNull(), "canonical_url match").when(F.col("any_id").isNull(), "no match")
        .when(F.col("clash").isNotNull(), "same name but conflicting domain/address/telephone").otherwise("name matches but no strong corroborating signal").alias("reason"),
    )


def resolve_in_order(records: DataFrame, entities: DataFrame, order: str = "seq") -> DataFrame:
    """As ``resolve``, but each record also meets the entities the records before it made or changed.

    Exact for every order-dependent case: a merge that changes the keys another
    record matches, a group whose first record goes to review. Each job is one
    task, so it suits jobs that fit into an executor; ``resolve`` is the way for
    larger ones, against what is stored.
    """
    keys = ["fingerprint", "canonical_url", "normalized_name"]
    side = ["domain", "address", "telephone"]
    r = records.select("job_id", F.col(order).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("id"), *keys, *side)
    e = entities.where("deleted_at is null").select("job_id", F.lit(-1).cast("bigint").alias("seq"), F.col("entity_id").alias("id"), *keys, *side)

    def job(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.astype(object).where(pdf.notna(), None).sort_values(["seq", "id"], na_position="last")
        rows: dict[str, dict] = {}
        index: dict[tuple[str, str], list[str]] = {}

        def add(i: str, row: dict) -> None:
            rows[i] = row
            for k in keys:
                if row[k]:
                    index.setdefault((k, row[k]), []).append(i)

        out = []
        for t in pdf.to_dict("records"):
            if t["id"] is not None:
                add(t["id"], t)
                continue
            alive = lambda k: sorted(i for i in index.get((k, t[k]), ()) if rows[i][k] == t[k]) if t[k] else []  # noqa: B023, E731
            strong = next(((k, hit[0]) for k in keys[:2] if (hit := alive(k))), None)
            same = alive("normalized_name")
            if strong:
                k, i = strong
                for c in [*keys[1:], *side]:
                    if t[c] and t[c].strip() and rows[i][c] != t[c]:
                        rows[i][c] = t[c]
                        if c in keys:
                            index.setdefault((c, t[c]), []).append(i)
                out.append((t["job_id"], t["seq"], "merge", i, f"{k} match"))
            elif same:
                clash = [i for i in same if any(t[c] and rows[i][c] and t[c] != rows[i][c] for c in side)]
                out.append((t["job_id"], t["seq"], "review", (clash or same)[0], "same name but conflicting domain/address/telephone" if clash else "name matches but no strong corroborating signal"))
            else:
                i = f"new-{t['seq']:012d}"
                add(i, dict(t))
                out.append((t["job_id"], t["seq"], "new", i, "no match"))
        return pd.DataFrame(out, columns=["job_id", "seq", "action", "entity_id", "reason"])

    return r.unionByName(e).groupBy("job_id").applyInPandas(job, "job_id string, seq bigint, action string, entity_id string, reason string")


def refreshed(entities: DataFrame, records: DataFrame, order: list[str], columns: list[str] = REFRESHED) -> DataFrame:
    """Entities with, per column, the last record value that is not blank; their own where there is none.

    ``data_json`` takes the records' ``fields_json`` over its own keys, later
    over earlier, nulls included.
    """
    at = F.struct(*order)
    new = records.where("entity_id is not null").groupBy("entity_id").agg(*(F.max_by(F.when(~is_blank(F.col(c)), F.col(c)), F.when(~is_blank(F.col(c)), at)).alias(f"_{c}") for c in columns), F.max("extracted_at").alias("_at"))
    joined = entities.join(new, "entity_id", "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.greatest("updated_at", "_at").alias(c) if c == "updated_at" else F.col(c) for c in entities.columns))


def merged_data(entities: DataFrame, records: DataFrame, order: list[str]) -> DataFrame:
    """(entity_id, key, value): the entity's data with the records' fields merged over it key by key."""
    kv = lambda df, c, rank: df.select("entity_id", rank.alias("rank"), F.explode(F.from_json(c, "map<string,string>")).alias("key", "value"))
    first = F.struct(F.lit(0).alias("n"), *(F.lit(None).cast(t).alias(o) for o, t in zip(order, _types(records, order))))
    all_ = kv(entities, "data_json", first).unionByName(kv(records.where("entity_id is not null"), "fields_json", F.struct(F.lit(1).alias("n"), *order)))
    return all_.groupBy("entity_id", "key").agg(F.max_by(F.struct("value"), "rank").alias("v")).select("entity_id", "key", "v.value")


def _types(df: DataFrame, cols: list[str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [kinds[c] for c in cols]


def evidence(records: DataFrame, keep: list[str]) -> DataFrame:
    """(``keep``, field, value): one row per field of a record, its common columns over its own keys."""
    common = F.map_filter(F.create_map(*(x for c in ("name", "canonical_url", "address", "telephone", "external_id") for x in (F.lit(c), F.col(c)))), lambda _k, v: v.isNotNull())
    fields = F.coalesce(F.from_json("fields_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return records.select(*keep, F.explode(F.map_concat(fields, common)).alias("field", "value"))


def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", fingerprint(F.col("entity_type"), F.col("normalized_name"), F.col("canonical_url"), F.col("domain"), F.col("external_id")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str] = ()) -> DataFrame:
    """Rows of both by ``keys``: the new row where there is one, but for columns ``kept`` of the old."""
    cols = old.columns
    a, b = old.select(*keys, F.struct(*cols).alias("_o")), new.select(*keys, F.struct(*cols).alias("_n"))
    j = a.join(b, keys, "full")
    return j.select(*(F.when(F.col("_n").isNull() | (F.lit(c in kept) & F.col("_o").isNotNull()), F.col(f"_o.{c}")).otherwise(F.col(f"_n.{c}")).alias(c) for c in cols))


def first_of(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
