"""Not-modified revisits resolved to the full response they stand for.

A revisit (HTTP 304) is joined, by canonical URL and time, to the latest
response of that URL captured strictly earlier. It is resolved if its validators
agree: entity tags by weak comparison if both have one, else Last-Modified if
both have one; payload digests must agree if both have one; a pair without any
validator in common is not accepted. A resolved revisit gets the response's
payload and its headers, updated by the revisit's headers except those that a
304 must not change.

The as-of join spreads one URL over many tasks: captures are range-partitioned
by URL and time, each range looks back within itself, and the last response of
every range and URL (at most one row per range) is carried to the ranges behind.
Payloads do not move; rows carry their digest and size.

Defined results: a revisit without URL or time is ``incomplete``. Without an
earlier response it is ``unmatched``, with disagreeing or missing validators
``mismatch``. Of responses at the same time the one with the larger record_id is
the later; a response at the very time of the revisit is not earlier. Repeated
revisits each give a row. NULL headers are empty; the header names are lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize

#: Headers of the stored response that a 304 does not replace: those that
#: describe the payload, and those that concern one connection only.
FIXED = ("content-length", "content-encoding", "content-type", "content-range", "content-md5",
         "transfer-encoding", "connection", "keep-alive", "proxy-authenticate",
         "proxy-authorization", "te", "trailer", "upgrade")
TRACKING = "^(utm_[^=]*|ref|sid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., m. and default ports; path without a
    closing slash; sorted parameters without tracking; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"),
                                 lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING))))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&")))
                    .otherwise(F.lit("")))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """``records``: record_id long, kind ('response' or 'revisit'), url, time
    long, headers map<string,string>, digest, size. One row per revisit:
    record_id, canonical_url, response_id, status, headers, digest, size."""
    empty = F.expr("cast(map() as map<string,string>)")
    every = records.filter(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").cast("long"), "kind", canonical_url(F.col("url")).alias("canonical_url"),
        F.col("time").cast("long").alias("time"), F.coalesce("headers", empty).alias("headers"),
        "digest", F.col("size").cast("long").alias("size"))
    whole = F.col("canonical_url").isNotNull() & F.col("time").isNotNull()
    lone = (every.filter(~whole & (F.col("kind") == "revisit"))
            .select("record_id", "canonical_url", F.lit(None).cast("long").alias("response_id"),
                    F.lit("incomplete").alias("status"), "headers", "digest", "size"))
    # at one time, revisits come first: a response must be strictly earlier
    place = [F.col("canonical_url"), F.col("time"), F.col("kind") == "response", F.col("record_id")]
    dealt = materialize(every.filter(whole).repartitionByRange(*place)
                        .withColumn("range", F.spark_partition_id()), "captures")
    is_response = F.col("kind") == "response"
    found = F.struct("record_id", "headers", "digest", "size")
    along = F.struct("time", "record_id")
    back = (Window.partitionBy("canonical_url", "range")
            .orderBy("time", F.col("kind") == "response", "record_id")
            .rowsBetween(Window.unboundedPreceding, -1))
    within = dealt.withColumn("near", F.last(F.when(is_response, found), ignorenulls=True).over(back))
    closing = dealt.groupBy("canonical_url", "range").agg(
        F.max_by(F.when(is_response, found), F.when(is_response, along)).alias("last"))
    behind = (Window.partitionBy("canonical_url").orderBy("range")
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = (closing.withColumn("far", F.last("last", ignorenulls=True).over(behind))
               .select("canonical_url", "range", "far").filter("far is not null"))
    joined = (within.filter("kind = 'revisit'").join(carried, ["canonical_url", "range"], "left")
              .withColumn("r", F.coalesce("near", "far")))

    mine, theirs = F.col("headers"), F.col("r.headers")
    tags = (mine["etag"], theirs["etag"])
    dates = (mine["last-modified"], theirs["last-modified"])
    both_tags = tags[0].isNotNull() & tags[1].isNotNull()
    both_dates = dates[0].isNotNull() & dates[1].isNotNull()
    both_digests = F.col("digest").isNotNull() & F.col("r.digest").isNotNull()
    agree = (F.when(both_tags, _strong(tags[0]) == _strong(tags[1]))
             .when(both_dates, dates[0] == dates[1]).otherwise(both_digests))
    agree = agree & (~both_digests | (F.col("digest") == F.col("r.digest")))
    status = (F.when(F.col("r").isNull(), "unmatched").when(agree, "resolved").otherwise("mismatch"))
    update = F.map_filter(mine, lambda k, v: ~k.isin(*FIXED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(update, k)), update)
    ok = F.col("status") == "resolved"
    done = joined.withColumn("status", status).select(
        "record_id", "canonical_url", F.when(ok, F.col("r.record_id")).alias("response_id"), "status",
        F.when(ok, merged).otherwise(mine).alias("headers"),
        F.when(ok, F.col("r.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(ok, F.col("r.size")).otherwise(F.col("size")).alias("size"))
    return done.unionByName(lone)


DAY = 86_400


def captures(pages: DataFrame) -> DataFrame:
    """Captures derived from ``pages``: each page is fetched once in full and
    asked for again twice, a day and some days later. By page_id the later
    requests carry a tag, a weak tag, only a date, a tag of another version, or
    come before the response."""
    p = F.col("page_id")
    when = p * 37 % 5000 * 600
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 12), F.lit('"'))
    date = F.concat(F.lit("day "), (p % 1000).cast("string"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    response = pages.select(
        (p * 4).alias("record_id"), F.lit("response").alias("kind"), "url", when.alias("time"),
        F.create_map(F.lit("etag"), tag, F.lit("last-modified"), date, F.lit("content-type"), F.lit("text/html"),
                     F.lit("content-length"), size.cast("string"), F.lit("cache-control"), F.lit("max-age=60")
                     ).alias("headers"),
        F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), size.cast("long").alias("size"))

    def again(n: int) -> DataFrame:
        style = (p + n) % 5
        sent = (F.when(style == 0, F.concat(F.lit("W/"), tag)).when(style == 3, F.lit('"other"'))
                .when(style != 2, tag))
        late = F.when(style == 4, -DAY).otherwise(DAY * n + p % 7 * 3600)
        headers = F.map_filter(
            F.create_map(F.lit("etag"), sent, F.lit("last-modified"), date, F.lit("content-length"), F.lit("0"),
                         F.lit("cache-control"), F.concat(F.lit("max-age="), (p % 9).cast("string")),
                         F.lit("date"), (when + late).cast("string")),
            lambda k, v: v.isNotNull())
        return pages.select((p * 4 + n).alias("record_id"), F.lit("revisit").alias("kind"), "url",
                            (when + late).alias("time"), headers.alias("headers"),
                            F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("size"))

    return response.unionByName(again(1)).unionByName(again(2))


def digest(resolved: DataFrame) -> DataFrame:
    lines = F.array_join(F.array_sort(F.transform(
        F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return resolved.select("record_id", "canonical_url", "response_id", "status",
                           F.sha2(lines, 256).alias("headers_sha256"), "digest", "size")
