"""Not-modified revisits of web archives, resolved to the latest earlier full response of the same canonical URL.

The as-of join works on record headers only, in time buckets: a bucket's own responses are searched by a window inside
the bucket, older ones by a running maximum over one row per (URL, bucket).  So the captures of one URL are split over
as many tasks as they span buckets, and payloads never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a 304 response that replace the stored ones (fixed by the HTTP caching rules).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
BUCKET_SECONDS = 86_400
#: Query parameters that do not change the page.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Lower-case host without ``www.`` or ``m.``, path, query without tracking parameters; no scheme or fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^(www|m)\\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.concat(F.lit("&"), F.regexp_extract(bare, "\\?(.*)$", 1))
    query = F.regexp_replace(F.regexp_replace(query, f"&({TRACKING})=[^&]*", ""), "^&+", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then fall together the last one stands."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    return F.coalesce(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)["value"])), F.create_map().cast("map<string,string>"))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, with the permitted ones of the revisit in their place. Names in lower case on both sides."""
    allowed = F.map_filter(fresh, lambda k, v: k.isin(*PERMITTED))
    rest = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(rest, allowed)


def _latest_earlier(records: DataFrame, bucket_seconds: int) -> DataFrame:
    """(record_id, target): for every revisit with URL and time, the largest (time, id) of the earlier responses."""
    micros = F.unix_micros("captured_at")
    events = records.filter("key IS NOT NULL AND captured_at IS NOT NULL").select(
        "key", "record_id", "is_revisit", micros.alias("micros"), F.floor(micros / (bucket_seconds * 1_000_000)).alias("bucket")
    )
    response = F.when(~F.col("is_revisit"), F.struct("micros", "record_id"))
    inside = Window.partitionBy("key", "bucket").orderBy("micros").rangeBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("near", F.max(response).over(inside)).filter("is_revisit")
    older = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy("key", "bucket").agg(F.max(response).alias("last")).select(
        F.col("key").alias("of_key"), F.col("bucket").alias("of_bucket"), F.max("last").over(older.partitionBy("key")).alias("carried")
    ).filter("carried IS NOT NULL")
    met = near.join(carried, (F.col("key") == F.col("of_key")) & (F.col("bucket") == F.col("of_bucket")), "left")
    return met.select("record_id", F.coalesce("near", "carried")["record_id"].alias("target"))


def resolve_revisits(responses: DataFrame, revisits: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row per revisit: (record_id, key, target_id, status, headers, payload_digest).

    Both tables have record_id (unique over both), url, captured_at (timestamp), headers (map); responses also have
    payload_digest.  The target is the latest response strictly earlier at the same canonical URL; of responses at one
    time the largest id.  ``status`` is ``no response``, ``mismatch`` or ``resolved``: an entity tag decides if the
    revisit has one (weak marks ignored), else the modification date, and a revisit with neither does not match.
    Only resolved revisits get merged headers and the payload digest.  A revisit without URL or time has no response;
    null headers count as none.  Rows repeated under one id are one record.
    """
    both = [
        responses.select("record_id", canonical_url(F.col("url")).alias("key"), "captured_at", F.lit(False).alias("is_revisit")),
        revisits.select("record_id", canonical_url(F.col("url")).alias("key"), "captured_at", F.lit(True).alias("is_revisit")),
    ]
    targets = _latest_earlier(both[0].union(both[1]), bucket_seconds).dropDuplicates(["record_id"])
    targets = targets.filter("target IS NOT NULL").withColumnRenamed("record_id", "of_record")
    stored = responses.select(
        F.col("record_id").alias("target_id"), _lower_keys(F.col("headers")).alias("stored"), "payload_digest"
    ).dropDuplicates(["target_id"])
    asked = revisits.select("record_id", canonical_url(F.col("url")).alias("key"), _lower_keys(F.col("headers")).alias("fresh"))
    rows = asked.dropDuplicates(["record_id"]).join(targets, F.col("record_id") == F.col("of_record"), "left")
    rows = rows.join(stored, F.col("target") == F.col("target_id"), "left")
    tag = lambda side: F.regexp_replace(F.col(side)["etag"], "^W/", "")
    agrees = F.when(tag("fresh").isNotNull(), tag("fresh") == tag("stored")).otherwise(
        F.col("fresh")["last-modified"] == F.col("stored")["last-modified"]
    )
    status = F.when(F.col("target_id").isNull(), "no response").when(agrees, "resolved").otherwise("mismatch")
    rows = rows.withColumn("status", status)
    good = F.col("status") == "resolved"
    return rows.select(
        "record_id", "key", "target_id", "status", F.when(good, merge_headers(F.col("stored"), F.col("fresh"))).alias("headers"),
        F.when(good, F.col("payload_digest")).alias("payload_digest"),
    )


def header_lines(headers: Column) -> Column:
    """``name: value`` lines, sorted by name."""
    lines = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(lines, "\n")
