"""Fingerprints, priorities and times derived from a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def fingerprint(entity_type: Column, name: Column, url: Column, domain: Column, external_id: Column) -> Column:
    """SHA-256 of the strongest signal: external id, link, name with domain, name; '' without any.

    Empty parts are left out of what is hashed.
    """
    kind, n, u, d, x = map(_filled, (entity_type, name, url, domain, external_id))
    of = lambda tag, *parts: F.sha2(F.concat_ws("|", F.lit(tag), kind, *parts), 256)
    return F.when(x.isNotNull(), of("external_id", x)).when(u.isNotNull(), of("url", u)).when(n.isNotNull() & d.isNotNull(), of("name_domain", n, d)).when(n.isNotNull(), of("name", n)).otherwise("")


def candidate_fingerprint(entity_type: Column, stable_id: Column, url: Column) -> Column:
    return F.coalesce(F.concat(entity_type, F.lit(":"), _filled(stable_id)), url)


def fetch_priority(confidence: Column) -> Column:
    return (F.lit(50) + confidence * 50).cast("int")


def retry_seconds(attempts: Column, retry_after: Column) -> Column:
    """What the host asked for, else 2^attempts up to an hour."""
    return F.coalesce(retry_after, F.least(F.pow(F.lit(2.0), attempts), F.lit(3600.0)))


def interval_seconds(schedule: Column) -> Column:
    """@minutely, @hourly, @daily, @weekly or ``@every <n><s|m|h|d>``; anything else is an hour."""
    s = F.trim(F.coalesce(schedule, F.lit("@hourly")))
    n = F.regexp_extract(s, r"^@every\s+(\d+)[smhd]$", 1).try_cast("bigint")
    unit = F.regexp_extract(s, r"^@every\s+\d+([smhd])$", 1)
    each = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.when(s == "@minutely", 60).when(s == "@daily", 86400).when(s == "@weekly", 604800).otherwise(F.coalesce(n * each, F.lit(3600))).cast("bigint")


def next_run(schedule: Column, base: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(base.cast("timestamp")) + interval_seconds(schedule) * 1_000_000).cast("timestamp_ntz")


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header, given as a number or an HTTP date; null if neither."""
    at = F.try_to_timestamp(F.regexp_replace(header, r"^\s*\w+,\s*", ""), F.lit("dd MMM yyyy HH:mm:ss zzz"))
    wait = (F.unix_micros(at) - F.unix_micros(now.cast("timestamp"))) / 1e6
    return F.coalesce(header.try_cast("double"), F.when(wait.isNotNull(), F.greatest(F.lit(0.0), wait)))
