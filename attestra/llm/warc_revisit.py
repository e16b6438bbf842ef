"""Not-modified revisits of a web archive, resolved to the full response that they stand for.

A revisit is joined as of its time to the latest earlier full response of the same canonical URL. Time is cut into
buckets: inside a bucket of a URL an ordered window finds the response, and what a bucket inherits from those before
comes from one row for each bucket of the URL. So a URL with a large part of all captures is spread over its buckets,
and page bodies never move: a resolved revisit names the response that has the body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import lower_ascii

BUCKET_SECONDS = 3600
#: Header fields that a not-modified response can't change (connection fields, and those that
#: describe the body it doesn't have).
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
TRACKING = "utm_"


def canonical_url(url: Column) -> Column:
    """Host (folded, without www. and default port), path without a last slash, and sorted query without tracking.

    Scheme and fragment don't count. Null where there is no host.
    """
    part = lambda i: F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    host = F.regexp_replace(F.regexp_replace(lower_ascii(part(1)), r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(part(2), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(part(3), "&"), lambda x: (x != "") & ~x.startswith(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _tag(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """(record_id, canonical_url, status, response_id, response_ts, headers) of every revisit.

    records: record_id long, url string, ts timestamp, is_revisit boolean, headers map<string, string>; further
    columns are ignored. Field names are folded; of fields that differ in case only, the last in order counts. Among
    earlier responses of one time the highest record_id is the latest; a response of the revisit's own time isn't
    earlier. status: `etag` or `last-modified` (that validator agrees, which decides if both sides have it, entity
    tags first), `unchecked` (no validator on both sides), `mismatch` (it differs; the response is named, nothing
    is merged), `no-response`. headers are the response's, updated by the revisit's permitted fields. A revisit
    without a usable URL or time is `no-response`, such a response is never met; a null is_revisit is a response;
    null headers are empty. Repeated rows are resolved row by row; an empty table gives no rows.
    """
    given = F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(given, lambda e: lower_ascii(e["key"])))
    last = lambda k: F.element_at(F.filter(given, lambda e: lower_ascii(e["key"]) == k), -1)["value"]
    once = F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("key"), last(k).alias("value"))))
    r = records.select(F.col("record_id").cast("long"), canonical_url(F.col("url")).alias("canonical_url"), "ts", F.coalesce("is_revisit", F.lit(False)).alias("is_revisit"), once.alias("headers"))
    lost = r.where("is_revisit and (canonical_url is null or ts is null)").withColumn("full", F.lit(None))
    r = r.where("canonical_url is not null and ts is not null").withColumn("bucket", F.floor(F.unix_micros("ts") / (bucket_seconds * 1_000_000)))
    full = F.when(~F.col("is_revisit"), F.struct("ts", "record_id", "headers"))
    here = Window.partitionBy("canonical_url", "bucket").orderBy("ts", F.col("is_revisit").desc(), "record_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = r.withColumn("inside", F.last(full, ignorenulls=True).over(here)).where("is_revisit")
    latest = F.max_by(full, F.when(~F.col("is_revisit"), F.struct("ts", "record_id")))
    before = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = r.groupBy("canonical_url", "bucket").agg(latest.alias("latest")).select("canonical_url", "bucket", F.last("latest", ignorenulls=True).over(before).alias("inherited"))
    placed = placed.join(heads, ["canonical_url", "bucket"], "left").withColumn("full", F.coalesce("inside", "inherited"))
    out = placed.select("record_id", "canonical_url", "headers", "full").unionByName(lost.select("record_id", "canonical_url", "headers", F.col("full").cast(placed.schema["full"].dataType).alias("full")))
    own, there = (lambda f: F.element_at("headers", f)), (lambda f: F.element_at("full.headers", f))
    both = lambda f: own(f).isNotNull() & there(f).isNotNull()
    status = (
        F.when(F.col("full").isNull(), "no-response")
        .when(both("etag"), F.when(_tag(own("etag")) == _tag(there("etag")), "etag").otherwise("mismatch"))
        .when(both("last-modified"), F.when(own("last-modified") == there("last-modified"), "last-modified").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    out = out.withColumn("status", status)
    new = F.map_filter("headers", lambda k, v: ~k.isin(*KEPT_FIELDS) & v.isNotNull())
    old = F.map_filter("full.headers", lambda k, v: ~F.map_contains_key(new, k))
    merged = F.when(~F.col("status").isin("no-response", "mismatch"), F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(old, new)))))
    return out.select("record_id", "canonical_url", "status", F.col("full.record_id").alias("response_id"), F.col("full.ts").alias("response_ts"), merged.alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Records as a crawler would leave them from (page_id, url, html): a response, and a later revisit, of each page.

    A page is captured at second page_id; it is asked for again 1000 seconds later for each character of its URL,
    with the entity tag of its own body. If another page was captured under the same canonical URL meanwhile, that
    one is the latest response, and its tag differs.
    """
    tag = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    size = F.length(F.coalesce("html", F.lit(""))).cast("string")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", tag.alias("tag"), size.alias("size"))
    first = p.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.timestamp_seconds("page_id").alias("ts"), F.lit(False).alias("is_revisit"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), "size", F.lit("ETag"), "tag", F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
    )
    again = p.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", F.timestamp_seconds(F.col("page_id") + 1000 * F.length(F.coalesce("url", F.lit("")))).alias("ts"), F.lit(True).alias("is_revisit"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("etag"), F.concat(F.lit("W/"), "tag"), F.lit("cache-control"), F.lit("max-age=3600")).alias("headers"),
    )
    return first.unionByName(again)
