"""WARC not-modified revisits: each takes its payload from the latest earlier full response of its URL.

An as-of join by canonical URL. Time is cut into buckets: the latest response of every (URL, bucket) is carried
over the buckets of a URL, and inside a bucket a running window does the rest. So no window holds more than one
URL's rows of one bucket, or one URL's buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Headers that a not-modified answer may update (RFC 9110, 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't tell pages apart.
IGNORED_PARAMETER = r"^(utm_[^=]*|fbclid|gclid)(=.*)?$"
URL_PARTS = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)([^?]*)\??(.*)$"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without closing slashes, the telling parameters sorted.

    Scheme and fragment don't count (as in the keys of web archives); a page that answers otherwise there has other validators and is told as
    "mismatch". Null gives null; what isn't an absolute URL stays as it is, trimmed.
    """
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    part = lambda n: F.regexp_extract(bare, URL_PARTS, n)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(part(2), r"/+$", "")
    told = F.filter(F.split(part(3), "&", -1), lambda p: (p != "") & ~p.rlike(IGNORED_PARAMETER))
    query = F.array_join(F.array_sort(told), "&")
    whole = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(bare.rlike(URL_PARTS), whole).otherwise(F.trim(url))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def _text(headers: Column) -> Column:
    """Headers in one string, by name."""
    told = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.array_sort(told), "; ")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, updated by the permitted ones of the not-modified answer."""
    fresh = F.map_filter(fresh, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)


def resolve_revisits(records: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Resolve every revisit of records.

    records: record_id, url, captured_at (epoch seconds, long), kind ("response" or "revisit"), etag,
    last_modified (strings), payload_digest (string), payload_length (long), headers (map of lower-case names). Other columns are
    ignored. A response without payload_digest isn't full, and rows of any other or no kind are neither responses nor revisits: both are passed over.
    The latest full response strictly before the revisit counts; of several at that instant, the one with the largest record_id, then payload_digest.

    Returns a row for each revisit: record_id, canonical_url, captured_at, status, validator, response_id,
    payload_digest, payload_length, headers. status: "resolved"; "mismatch" (the etag, compared weakly, or else the
    modification date differs); "unchecked" (no validator that both have); "missing" (no earlier full response, or no URL
    or time). Only resolved rows have a payload and headers. Null headers count as none. Repeated rows give repeated rows; no rows give no rows.
    """
    none = F.lit(None)
    empty = F.create_map().cast("map<string,string>")
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("captured_at").cast("long").alias("captured_at"),
        (F.col("kind") == "response").alias("is_response"), "etag", "last_modified", "payload_digest",
        F.col("payload_length").cast("long").alias("payload_length"), F.coalesce("headers", empty).alias("headers"), F.col("kind").alias("_kind"),
    ).where("_kind = 'revisit' or (_kind = 'response' and payload_digest is not null)").drop("_kind")
    placed = rows.where("canonical_url is not null and captured_at is not null")
    lost = rows.where("(canonical_url is null or captured_at is null) and not is_response")
    names = ["record_id", "captured_at", "etag", "last_modified", "payload_digest", "payload_length", "headers"]
    held = F.struct(*names)
    placed = placed.withColumn("bucket", F.floor(F.col("captured_at") / bucket_seconds))
    latest = placed.where("is_response").groupBy("canonical_url", "bucket").agg(F.max_by(held, F.struct("captured_at", "record_id", "payload_digest")).alias("latest"))
    buckets = placed.select("canonical_url", "bucket").distinct().join(latest, ["canonical_url", "bucket"], "left")
    before = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("canonical_url", "bucket", F.last("latest", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("canonical_url", "bucket").orderBy("captured_at", "is_response", "record_id", "payload_digest").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.last(F.when(F.col("is_response"), held), ignorenulls=True).over(inside)).where("not is_response")
    found = near.join(carried, ["canonical_url", "bucket"], "left").withColumn("base", F.coalesce("near", "carried"))
    own_tag, base_tag = _tag(F.col("etag")), _tag(F.col("base.etag"))
    by_tag, by_date = own_tag.isNotNull() & base_tag.isNotNull(), F.col("last_modified").isNotNull() & F.col("base.last_modified").isNotNull()
    validator = F.when(by_tag, "etag").when(by_date, "last_modified")
    same = F.when(by_tag, own_tag == base_tag).when(by_date, F.trim("last_modified") == F.trim(F.col("base.last_modified")))
    status = F.when(F.col("base").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    told = found.withColumn("status", status).withColumn("validator", validator)
    ok = F.col("status") == "resolved"
    told = told.select(
        "record_id", "canonical_url", "captured_at", "status", "validator", F.col("base.record_id").alias("response_id"),
        F.when(ok, F.col("base.payload_digest")).alias("payload_digest"), F.when(ok, F.col("base.payload_length")).alias("payload_length"),
        F.when(ok, merged_headers(F.col("base.headers"), F.col("headers"))).alias("headers"),
    )
    kinds = dict(told.dtypes)
    lost = lost.select("record_id", "canonical_url", "captured_at", F.lit("missing").alias("status"), *(none.cast(kinds[c]).alias(c) for c in ("validator", "response_id", "payload_digest", "payload_length", "headers")))
    return told.unionByName(lost)


def header_text(headers: Column) -> Column:
    """Headers as one string (name=value, by name, joined by "; ")."""
    return _text(headers)
