"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, conv_repair, cotrain, decontam, langid, line_runs, minhash, pii, quality_rules, seed_dedup,
               suffix_dedup, vector_codes, warc)
from .base import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


TOKENIZER = "byte_bpe_multi_50k.tiktoken"


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER),
                         public_tokenizers.PATTERN)
    return bpe.digest(encoded)


def op8_sql() -> str:
    """Windows as lists of words, joined by equality; hit words by position."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    fold = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            f"'abcdefghijklmnopqrstuvwxyz'), {word})")
    return f"""
    WITH d AS (SELECT doc_id, {fold} AS w FROM documents),
    b AS (SELECT item_id, {fold} AS w FROM benchmark WHERE item_id IS NOT NULL),
    bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g, least(len(w), 13) AS m
           FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) r(i) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT m FROM bw),
    dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
           FROM d, sizes, unnest(range(1, len(w) - m + 2)) r(i)),
    hits AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw USING (g, m)),
    pos AS (SELECT DISTINCT doc_id, p FROM (SELECT DISTINCT doc_id, i, m FROM hits) h,
            unnest(range(i, i + m)) r(p)),
    nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
    ni AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
           FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)"""


ORACLE["op8_decontamination"] = op8_sql()


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_benchmark(documents(spark, sf_dir),
                                    spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontam.digest(found)


ORACLE["op9_near_duplicates"] = r"""
    WITH RECURSIVE t AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
          FROM t, unnest(range(1, greatest(len(w) - 2, 1) + 1)) r(i) WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
               FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
             WHERE 100 * c >= 85 * (na.n + nb.n - c)),
    reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
    low AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a)
    SELECT t.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, t.doc_id) AS component_id,
           coalesce(component_id, t.doc_id) = t.doc_id AS kept
    FROM t LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = t.doc_id"""


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), shingle=3, percent=85)


ORACLE["op10_substring_dedup"] = r"""
    WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM t, unnest(range(1, len(w) - 11)) r(i)),
    low AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
    gone AS (SELECT DISTINCT doc_id, p FROM win JOIN low USING (g), unnest(range(i, i + 13)) r(p)
             WHERE d < doc_id),
    word AS (SELECT doc_id, p, w[p] AS x FROM t, unnest(range(1, len(w) + 1)) r(p)),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p)
             GROUP BY doc_id),
    lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
           sha256(coalesce(s, '')) AS kept_sha256
    FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_dedup.removal_digest(documents(spark, sf_dir))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digest(documents(spark, sf_dir))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.filter(~out).select("text", "lang"))
    return langid.predict(docs, model).withColumn("held_out", out)


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir),
                                     spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.digest(pii.find(docs, pii.train(docs)))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return cotrain.score(docs, cotrain.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


ORACLE["op2_warc_revisits"] = r"""
    WITH p AS (SELECT page_id AS p, url, coalesce(html, '') AS html, page_id * 37 % 5000 * 600 AS t,
                      '"' || substr(md5(coalesce(html, '')), 1, 12) || '"' AS tag,
                      'day ' || CAST(page_id % 1000 AS VARCHAR) AS date FROM pages),
    bare AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM p),
    split AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*')), ':(80|443)$', ''),
                        '^(www|m)\.', '') AS host,
              regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
              list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'),
                  lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|sid|sessionid)(=|$)'))) AS q FROM bare),
    c AS (SELECT *, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS u FROM split),
    response AS (SELECT p * 4 AS id, u, t, tag, date, sha256(html) AS digest, strlen(html) AS size FROM c),
    again AS (SELECT p * 4 + n AS id, u, date, p % 9 AS age,
              CASE (p + n) % 5 WHEN 0 THEN 'W/' || tag WHEN 3 THEN '"other"' WHEN 2 THEN NULL ELSE tag END AS sent,
              t + CASE WHEN (p + n) % 5 = 4 THEN -86400 ELSE 86400 * n + p % 7 * 3600 END AS t
              FROM c, (VALUES (1), (2)) v(n)),
    near AS (SELECT a.*, r.id AS rid, r.tag AS rtag, r.date AS rdate, r.digest, r.size,
             row_number() OVER (PARTITION BY a.id ORDER BY r.t DESC NULLS LAST, r.id DESC) AS k
             FROM again a LEFT JOIN response r ON r.u = a.u AND r.t < a.t),
    judged AS (SELECT *, CASE WHEN rid IS NULL THEN 'unmatched'
               WHEN CASE WHEN sent IS NOT NULL THEN regexp_replace(sent, '^W/', '') = rtag ELSE date = rdate END
               THEN 'resolved' ELSE 'mismatch' END AS status FROM near WHERE k = 1)
    SELECT id AS record_id, u AS canonical_url, CASE WHEN status = 'resolved' THEN rid END AS response_id, status,
           sha256('cache-control: max-age=' || CAST(age AS VARCHAR) || chr(10)
               || 'content-length: ' || CASE WHEN status = 'resolved' THEN CAST(size AS VARCHAR) ELSE '0' END || chr(10)
               || CASE WHEN status = 'resolved' THEN 'content-type: text/html' || chr(10) ELSE '' END
               || 'date: ' || CAST(t AS VARCHAR)
               || coalesce(chr(10) || 'etag: ' || coalesce(sent, CASE WHEN status = 'resolved' THEN rtag END), '')
               || chr(10) || 'last-modified: ' || date) AS headers_sha256,
           CASE WHEN status = 'resolved' THEN digest END AS digest,
           CASE WHEN status = 'resolved' THEN CAST(size AS BIGINT) END AS size
    FROM judged"""


@query
def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.digest(warc.resolve(warc.captures(pages)))


ORACLE["op11_line_runs"] = r"""
    WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
    line AS (SELECT doc_id, i, w[i] AS line, translate(trim(w[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
             FROM t, unnest(range(1, len(w) + 1)) r(i)),
    low AS (SELECT key, min(doc_id) AS d FROM line WHERE length(key) >= 10 GROUP BY key),
    judged AS (SELECT line.*, coalesce(d < doc_id, false) AS gone FROM line LEFT JOIN low USING (key))
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id"""


@query
def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.digest(documents(spark, sf_dir))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_repair.digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
