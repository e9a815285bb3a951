"""What came back from a fetch: its class, its hash, and whether it changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Content types that are read, and words of pages that refuse a robot.
READ_TYPES = ("text/html", "application/xhtml+xml", "application/xml", "text/xml", "application/json")
REFUSALS = ("captcha", "are you a human", "unusual traffic", "access denied")


def refuses(body: Column) -> Column:
    head = F.lower(F.substring(body, 1, 5000))
    out = F.lit(False)
    for w in REFUSALS:
        out = out | F.coalesce(head.contains(w), F.lit(False))
    return out


def outcome(status: Column, content_type: Column, body: Column) -> Column:
    """Class of an answer; the first rule that holds decides, other 4xx count as read."""
    kind = F.lower(F.trim(F.element_at(F.split(F.coalesce(content_type, F.lit("")), ";"), 1)))
    readable = kind == ""
    for t in READ_TYPES:
        readable = readable | kind.startswith(t)
    return (
        F.when(status == 304, "unchanged").when(status == 429, "rate_limited").when(status == 403, "forbidden").when(status == 404, "not_found").when(status >= 500, "server_error")
        .when(~readable, "unsupported_type").when(refuses(body), "blocked_page").otherwise("ok")
    )


def changed(df: DataFrame, key: str = "url", order: str = "fetched_at", body: str = "content") -> DataFrame:
    """Adds ``body_hash`` and ``is_changed``: false where the previous fetch of the key had the same body."""
    w = Window.partitionBy(key).orderBy(order, "fetch_id")
    hashed = df.withColumn("body_hash", F.sha2(F.col(body), 256))
    return hashed.withColumn("is_changed", ~F.col("body_hash").eqNullSafe(F.lag("body_hash").over(w)) | F.col("body_hash").isNull())
