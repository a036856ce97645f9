import random

import pytest
from pyspark.sql import functions as F

from qualmark.llm import warc

SCHEMA = ("record_id long, kind string, url string, time long, headers map<string,string>, digest string, "
          "size long, status string, range string, near string, r string")


def records(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def strong(tag):
    return tag.removeprefix("W/")


def expected(rows):
    """Every revisit against all responses."""
    out = {}
    for rid, kind, url, time, headers, digest, size in rows:
        if kind != "revisit":
            continue
        headers = headers or {}
        if url is None or time is None:
            out[rid] = ("incomplete", None, headers)
            continue
        before = [r for r in rows if r[1] == "response" and r[2] == url and r[3] is not None and r[3] < time]
        if not before:
            out[rid] = ("unmatched", None, headers)
            continue
        _, _, _, _, theirs, full, _ = last = max(before, key=lambda r: (r[3], r[0]))
        theirs = theirs or {}
        if "etag" in headers and "etag" in theirs:
            ok = strong(headers["etag"]) == strong(theirs["etag"])
        elif "last-modified" in headers and "last-modified" in theirs:
            ok = headers["last-modified"] == theirs["last-modified"]
        else:
            ok = digest is not None and full is not None
        ok = ok and (digest is None or full is None or digest == full)
        merged = {**theirs, **{k: v for k, v in headers.items() if k not in warc.FIXED}}
        out[rid] = ("resolved", last[0], merged) if ok else ("mismatch", None, headers)
    return out


def made(n, urls, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["response", "revisit", "revisit", "metadata"])
        headers = rng.choice([None, {}, {"etag": rng.choice(['"a"', 'W/"a"', '"b"']), "content-length": "9"},
                              {"last-modified": rng.choice(["d1", "d2"]), "date": str(i)},
                              {"etag": '"a"', "last-modified": "d1", "content-type": "text/html", "age": "1"}])
        rows.append((i, kind, rng.choice([*urls, urls[0], urls[0], None]), rng.choice([*range(30), None]), headers,
                     rng.choice([None, "x", "y"]), rng.choice([None, 5])))
    return rows


def check(spark, rows, partitions):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.record_id: (r.status, r.response_id, r.headers) for r in
               warc.resolve(records(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == expected(rows)


@pytest.mark.parametrize("partitions", [1, 7, 23])
def test_one_url_over_many_ranges(spark, partitions):
    check(spark, made(400, ["h/a", "h/b"], partitions), partitions)


def test_responses_far_behind(spark):
    rows = [(0, "response", "h/a", 0, {"etag": '"a"'}, None, 7)]
    rows += [(i, "revisit", "h/a", i, {"etag": '"a"'}, None, None) for i in range(1, 200)]
    check(spark, rows, 9)


def test_repeated_rows_and_empty(spark):
    row = (1, "revisit", "h/a", 5, {"etag": '"a"'}, None, None)
    got = warc.resolve(records(spark, [row, row, (0, "response", "h/a", 1, {"etag": '"a"'}, "d", 3)])).collect()
    assert [(r.record_id, r.status, r.digest, r["size"]) for r in got] == [(1, "resolved", "d", 3)] * 2
    assert warc.resolve(records(spark, [])).collect() == []


@pytest.mark.parametrize("url, want", [
    ("http://www.Example.com:80/a/?utm_source=x&b=2&a=1#top", "example.com/a?a=1&b=2"),
    ("https://m.example.com/a", "example.com/a"), ("example.com", "example.com"), ("", ""),
    ("https://example.com/?ref=x", "example.com"), ("https://example.com/P?refs=1", "example.com/P?refs=1"), (None, None)])
def test_canonical_url(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(warc.canonical_url(F.col("u")).alias("c")).first().c == want


def test_captures_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/b", None, "x"), (2, None, "<p>", "y"), (3, "http://a/b", "", "z")],
                                  "page_id long, url string, html string, kind string")
    out = warc.digest(warc.resolve(warc.captures(pages)))
    assert out.count() == 6 and out.filter("canonical_url is null").count() == 2
