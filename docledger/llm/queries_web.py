"""Registered queries of revisits, main text, licenses and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.llm import html, licenses, quality, warc
from docledger.llm.common import table
from docledger.llm.registry import query

#: Crawl times that the query gives the pages: one a minute, and a second visit some hours later.
FIRST_VISIT, APART, LATER = 1_700_000_000, 60, 3_600


def crawl_records(pages):
    """Each page as a full response and as a later not-modified visit with validators."""
    etag = F.md5(F.coalesce("html", F.lit("")))
    at = F.col("page_id") * APART + FIRST_VISIT
    again = at + (1 + F.col("page_id") % 50) * LATER
    text = lambda c: F.concat(F.lit('t'), c.cast("string"))
    first = pages.select(
        (F.col("page_id") * 2).alias("record_id"),
        "url",
        F.timestamp_seconds(at).alias("time"),
        F.lit("response").alias("kind"),
        F.create_map(
            F.lit("ETag"), F.concat(F.lit('W/'), etag), F.lit("Date"), text(at), F.lit("Content-Type"), F.lit("text/html"),
            F.lit("Content-Length"), F.length("html").cast("string"),
        ).alias("headers"),
        F.sha1(F.coalesce("html", F.lit(""))).alias("digest"),
    )
    second = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        "url",
        F.timestamp_seconds(again).alias("time"),
        F.lit("revisit").alias("kind"),
        F.create_map(
            F.lit("ETag"), F.when(F.col("page_id") % 7 != 0, etag), F.lit("date"), text(again), F.lit("Content-Length"), F.lit("0")
        ).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return first.unionByName(second)


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u, md5(coalesce(html, '')) AS etag, length(html) AS n,
         page_id * 60 + 1700000000 AS at, page_id * 60 + 1700000000 + (1 + page_id % 50) * 3600 AS again
  FROM pages
), cut AS (
  SELECT *, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)\??(.*)$', 1) AS scheme,
         regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)\??(.*)$', 2) AS host,
         regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)\??(.*)$', 3) AS path,
         array_to_string(list_sort(list_filter(string_split(
           regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)\??(.*)$', 4), '&'), lambda x: x <> '' AND NOT
           regexp_matches(x, '(?i)^(utm_[a-z]+|fbclid|gclid|msclkid|phpsessid|ref|sessionid|sid)(=|$)'))), '&') AS query
  FROM p
), c AS (
  SELECT *, CASE WHEN scheme = '' THEN u ELSE
    regexp_replace(lower(scheme), '^https$', 'http') || '://'
    || regexp_replace(regexp_replace(lower(host), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(path, '/+$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical_url
  FROM cut
), j AS (
  SELECT v.page_id, v.canonical_url, v.again, v.n, b.page_id AS base, b.n AS base_n,
         CASE WHEN v.page_id % 7 <> 0 THEN v.etag END AS own, b.etag AS other
  FROM c v ASOF LEFT JOIN c b ON v.canonical_url = b.canonical_url AND v.again > b.at
)
SELECT page_id * 2 + 1 AS record_id, canonical_url, again AS seconds,
       CASE WHEN base IS NULL THEN 'no_response' WHEN own IS NULL THEN 'unverified' WHEN own = other THEN 'resolved' ELSE 'mismatch' END AS outcome,
       CASE WHEN own = other THEN base * 2 END AS refers_to, own AS etag, 't' || again AS date,
       CASE WHEN own = other THEN 'text/html' END AS content_type,
       CASE WHEN own = other THEN CAST(base_n AS VARCHAR) ELSE '0' END AS content_length
FROM j
"""


@query("op1_revisits", OP1_SQL)
def op1(spark, sf_dir):
    found = warc.resolve_revisits(crawl_records(table(spark, sf_dir, "pages")))
    header = lambda name: F.col("headers")[name]
    return found.select(
        "record_id", "canonical_url", F.unix_seconds("time").alias("seconds"), "outcome", "refers_to",
        header("etag").alias("etag"), header("date").alias("date"), header("content-type").alias("content_type"),
        header("content-length").alias("content_length"),
    )


@query("op4_licenses")
def op4(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("licenses").alias("x")).select("doc_id", "x.*")


@query("op5_quality")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.learn(docs))
    return judged.select("doc_id", "votes", "form_bad", "tone_bad", "form_score", "tone_score", "keep")


@query("op6_main_text")
def op6(spark, sf_dir):
    found = html.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", "n_chars")
