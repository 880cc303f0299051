"""Not-modified revisit resolution for web archives (operator 4).

A revisit record stands for a response that the server did not send again. It is resolved by an as-of join
on the canonical URL to the latest strictly earlier full response (status 200 with a payload). The revisit's
validators are checked against that response: the entity tag by weak comparison if there is one, else the
date of last modification. If they agree, the revisit gets that response's payload and its headers, updated
by those headers that a not-modified answer may carry.

Captures have record_id, url, captured_at, type (``response`` or ``revisit``), status, headers (map, names in
any case) and payload. Outcomes: ``resolved``, ``changed`` (validators differ), ``unverified`` (the revisit or
the response has none to compare), ``missing`` (no earlier full response, a null URL or time). Only resolved
ones have a payload. Responses at one instant: the largest record_id counts. Repeated revisits are resolved
each; of responses that share a record_id any one is taken. Null headers count as none, empty payloads as
payloads. Tables without rows give none. Further columns of the captures are ignored.

The as-of step is two-level (``scan.running``): only summaries of a URL's time slices meet in one place, and
it carries no payloads; these are fetched by record_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.operators import scan

SLICE_SECONDS = 86_400
# fixed values: headers that an answer of status 304 updates in the stored response
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified"]
#: Query parameters that do not select another page.
TRACKING = r"^(utm_.*|ref|fbclid|gclid|sessionid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, default port, ``www.``, fragment, final slash and tracking parameters; the rest sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    params = F.split(F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(params, lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.regexp_replace(host, r"^www\.", ""), path, query)


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the last one's value."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda acc, e: F.map_concat(
        F.map_filter(acc, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])))


def weak(tag: Column) -> Column:
    return F.regexp_replace(F.btrim(tag), r"^W/", "")


def resolve(captures: DataFrame, payload: str = "payload") -> DataFrame:
    """One row for each revisit: record_id, url_key, captured_at, outcome, refers_to, headers, payload."""
    base = captures.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "captured_at", "type", "status",
        lower_names(F.col("headers")).alias("headers"), F.col(f"`{payload}`").alias("payload"))
    is_full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("payload").isNotNull()
    marked = base.withColumn("is_full", F.coalesce(is_full, F.lit(False)))
    slim = marked.where((F.col("type") == "revisit") | F.col("is_full")).select(
        "record_id", "url_key", "captured_at", "is_full",
        F.try_element_at("headers", F.lit("etag")).alias("etag"), F.try_element_at("headers", F.lit("last-modified")).alias("modified"),
        F.when(~F.col("is_full"), F.col("headers")).alias("sent"))
    full = F.struct("record_id", "etag", "modified")
    known = slim.where("url_key is not null and captured_at is not null")
    found = scan.running(known, ["url_key"], ["captured_at", "is_full", "record_id"], scan.time_bucket("captured_at", SLICE_SECONDS),
                         {"stored": ("last", F.when(F.col("is_full"), full))})
    left = slim.where("url_key is null or captured_at is null").withColumn("stored", F.lit(None).cast(found.schema["stored"].dataType))
    found = found.unionByName(left).where("not is_full")
    same = F.when(F.col("etag").isNotNull() & F.col("stored.etag").isNotNull(), weak(F.col("etag")) == weak(F.col("stored.etag"))).otherwise(
        F.col("modified") == F.col("stored.modified"))
    outcome = F.when(F.col("stored").isNull(), "missing").when(same.isNull(), "unverified").when(same, "resolved").otherwise("changed")
    checked = found.select("record_id", "url_key", "captured_at", "sent", F.col("stored.record_id").alias("refers_to"), outcome.alias("outcome"))
    stored = (marked.where("is_full").groupBy(F.col("record_id").alias("s_id")).agg(
        F.max_by(F.struct("headers", "payload"), F.struct("captured_at", F.xxhash64("payload"))).alias("s")))
    allowed = F.map_filter("sent", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("s.headers", lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    joined = checked.join(stored, (F.col("refers_to") == F.col("s_id")) & (F.col("outcome") == "resolved"), "left")
    return joined.select(
        "record_id", "url_key", "captured_at", "outcome", "refers_to",
        F.when(F.col("s").isNotNull(), merged).otherwise(F.col("sent")).alias("headers"), F.col("s.payload").alias("payload"))
