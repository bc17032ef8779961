"""Resolution of not-modified revisits in web archives.

A revisit record says that a page had not changed; what it stands for is the latest earlier
full response of the same canonical address. The two are put together by an as-of join, their
validators are compared, and the headers that a 304 answer may update are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Time units that one task orders for one address; only one response per stretch is carried on.
STRETCH = 1 << 16

# The fields that a not-modified answer updates in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"

HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Address without scheme, ``www.``, default port, fragment, tracking parameters and closing
    slash; host in lower case, parameters sorted. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    head = F.substring_index(bare, "?", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(head, "^([^/]*)", 1)), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(head, "^[^/]*(.*)$", 1), "/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _lower_named(headers: Column) -> Column:
    """Headers as an array by name; of names that differ in case the last in order stays."""
    entries = F.coalesce(F.map_entries(headers), F.from_json(F.lit("[]"), "array<struct<key:string,value:string>>"))
    named = F.array_sort(F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value"))))
    return F.filter(named, lambda h, i: (i + 1 == F.size(named)) | (F.coalesce(F.get(named, i + 1)["name"], F.lit("")) != h["name"]))


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers with the permitted fields of the update, by name."""
    allowed = F.filter(update, lambda h: h["name"].isin(*PERMITTED))
    rest = F.filter(stored, lambda h: ~F.exists(allowed, lambda a: a["name"] == h["name"]))
    return F.array_sort(F.concat(rest, allowed))


def _same(etag_a: Column, etag_b: Column, date_a: Column, date_b: Column) -> Column:
    """True or false by weak comparison of entity tags, else by modification dates; null without either."""
    plain = lambda t: F.regexp_replace(t, "^W/", "")
    return F.coalesce(plain(etag_a) == plain(etag_b), date_a == date_b)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit (``status`` 304) of ``records``: ``record_id, url_key, ts, outcome,
    refers_to, headers, payload_sha256, payload_bytes``.

    ``records`` has ``record_id, url, ts (long), status, etag, last_modified, headers (map),
    payload``; other columns are ignored. Full responses have status 200. ``outcome`` is
    ``resolved``, ``validator_mismatch``, ``no_validator`` or ``no_response``; only where it is
    resolved are headers merged and the payload named, else the revisit keeps its own headers.
    Of responses at one time the largest ``record_id`` counts. A null address or time, or a
    response with one, meets nothing. Repeated revisits give repeated rows.
    """
    slim = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "status", "etag", "last_modified",
        _lower_named(F.col("headers")).alias("headers"),
        F.when(F.col("status") == 200, F.sha2(F.coalesce("payload", F.lit("")).cast("binary"), 256)).alias("payload_sha256"),
        F.when(F.col("status") == 200, F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")).alias("payload_bytes"),
    ).withColumn("stretch", F.floor(F.col("ts") / STRETCH))
    full = (F.col("status") == 200) & F.col("ts").isNotNull()
    response = F.when(full, F.struct("ts", "record_id", "etag", "last_modified", "headers", "payload_sha256", "payload_bytes"))
    known = slim.filter(F.col("status").isin(200, 304) & F.col("url_key").isNotNull() & F.col("ts").isNotNull())
    marked = known.withColumn("response", response)
    earlier = Window.partitionBy("url_key", "stretch").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = marked.withColumn("near", F.max("response").over(earlier)).filter("status = 304")
    before = Window.partitionBy("url_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = marked.groupBy("url_key", "stretch").agg(F.max("response").alias("end"))
    carried = ends.select("url_key", "stretch", F.max("end").over(before).alias("far"))
    found = near.join(carried, ["url_key", "stretch"], "left").withColumn("r", F.coalesce("near", "far"))
    lost = slim.filter((F.col("status") == 304) & (F.col("url_key").isNull() | F.col("ts").isNull()))
    found = found.unionByName(lost, allowMissingColumns=True)
    same = _same(F.col("etag"), F.col("r.etag"), F.col("last_modified"), F.col("r.last_modified"))
    outcome = (
        F.when(F.col("r").isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("validator_mismatch")
    )
    is_it = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id",
        "url_key",
        "ts",
        "outcome",
        F.col("r.record_id").alias("refers_to"),
        F.when(is_it, merged_headers(F.col("r.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(is_it, F.col("r.payload_sha256")).alias("payload_sha256"),
        F.when(is_it, F.col("r.payload_bytes")).alias("payload_bytes"),
    )


def header_lines(headers: Column) -> Column:
    return F.array_join(F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), F.coalesce(h["value"], F.lit("")))), "\n")
