"""Not-modified revisits of WARC captures, resolved to what they stand for.

A revisit record has headers and validators but no body. It is joined, as of its time, to the latest earlier
full response of its canonical URL. Where the validators agree, the revisit takes over that
response's body and headers, with the headers that a not-modified answer may update put on top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The running look-back goes over so many seconds of one URL at a time; earlier spans hand on their last response.
SPAN_SECONDS = 86_400

# Headers that a not-modified answer may update.
UPDATED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "server", "set-cookie", "vary", "warning")
# Query parameters that name a visit, not a page.
VISIT_PARAMETERS = ("fbclid", "gclid", "msclkid", "phpsessid", "ref", "sessionid", "sid")


def canonical_url(url: Column) -> Column:
    """http and https, case of scheme and host, `www.`, default ports, fragments, visit parameters, parameter
    order, empty queries and a closing slash make no difference. Null stays null."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    part = lambda i: F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)\??(.*)$", i)
    scheme = F.regexp_replace(F.lower(part(1)), "^https$", "http")
    host = F.regexp_replace(F.regexp_replace(F.lower(part(2)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(part(3), r"/+$", "")
    drop = "|".join(VISIT_PARAMETERS)
    asked = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~p.rlike(rf"(?i)^(utm_[a-z]+|{drop})(=|$)"))
    query = F.array_join(F.array_sort(asked), "&")
    built = F.concat(scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(part(1) == "", plain).otherwise(built)


def resolve_revisits(
    records: DataFrame,
    record_id: str = "record_id",
    url: str = "url",
    time: str = "time",
    kind: str = "kind",
    headers: str = "headers",
    digest: str = "digest",
    span_seconds: int = SPAN_SECONDS,
) -> DataFrame:
    """(record_id, canonical_url, time, outcome, refers_to, headers) for each revisit record.

    `records` has a timestamp `time`, `kind` "response" or "revisit" (others are ignored), `headers` as
    map<string, string> and a payload `digest`. The response is the latest strictly earlier one of
    the URL; of several at that time, the one with the greatest id. outcome is `resolved` if no validator
    disagrees and at least one agrees (strong or weak etag, last-modified, digest); `unverified` if both
    sides share no validator; `mismatch` if one disagrees; `no_response` without an earlier
    response or without url or time. Headers are those of the response, updated by the permitted headers
    of the revisit, names in lower case; for outcomes other than `resolved` the revisit's own.

    Null headers are empty; of names that differ in case only the first in byte order counts. Every revisit row gives a row, repeated rows and null ids included, an empty
    table none. A URL may hold any share of the rows: they are looked through span by span of time, and only
    one row per URL and span goes on to later spans. Other columns are ignored.
    """
    named = F.coalesce(F.col(headers), F.create_map().cast("map<string,string>"))
    entries = F.array_sort(F.map_entries(F.map_filter(named, lambda k, v: v.isNotNull())))
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(lowered, lambda e: e["key"])
    low = F.map_from_entries(F.filter(lowered, lambda e, i: F.array_position(names, e["key"]) == i + 1))
    rows = records.select(
        F.col(record_id).alias("record_id"),
        canonical_url(F.col(url)).alias("canonical_url"),
        F.col(time).cast("timestamp").alias("time"),
        F.lower(F.col(kind)).alias("kind"),
        low.alias("headers"),
        F.col(digest).alias("digest"),
    ).where(F.col("kind").isin("response", "revisit"))
    placed = rows.withColumn("span", F.floor(F.unix_micros("time") / F.lit(span_seconds * 1_000_000)))
    can = F.col("canonical_url").isNotNull() & F.col("time").isNotNull()
    # The look-back carries a response's time, id and validators only.
    brief = F.struct(
        F.col("time").alias("t"),
        F.col("record_id").alias("id"),
        F.col("headers")["etag"].alias("etag"),
        F.col("headers")["last-modified"].alias("modified"),
        F.col("digest").alias("digest"),
    )
    response = F.when(F.col("kind") == "response", brief)
    key = ["canonical_url", "span"]
    last = placed.where(can).groupBy(*key).agg(F.max(response).alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.max("last").over(before)).drop("last")
    # Up to one microsecond before the row's own time.
    ticks = Window.partitionBy(*key).orderBy(F.unix_micros("time")).rangeBetween(Window.unboundedPreceding, -1)
    seen = placed.where(can).withColumn("within", F.max(response).over(ticks))
    wanted = seen.where(F.col("kind") == "revisit").join(carried, key, "left")
    wanted = wanted.withColumn("base", F.coalesce("within", "carried")).drop("within", "carried", "span")
    rest = placed.where(~can & (F.col("kind") == "revisit")).drop("span").withColumn("base", F.lit(None).cast(seen.schema["within"].dataType))
    asked = wanted.unionByName(rest)

    weak = lambda c: F.regexp_replace(c, r"^\s*(?:W/)?|\s+$", "")
    pairs = (
        (weak(F.col("headers")["etag"]), weak(F.col("base.etag"))),
        (F.trim(F.col("headers")["last-modified"]), F.trim(F.col("base.modified"))),
        (F.col("digest"), F.col("base.digest")),
    )
    agree = F.lit(False)
    differ = F.lit(False)
    for own, other in pairs:
        agree = agree | F.coalesce(own == other, F.lit(False))
        differ = differ | F.coalesce(own != other, F.lit(False))
    outcome = (
        F.when(F.col("base").isNull(), "no_response").when(differ, "mismatch").when(agree, "resolved").otherwise("unverified")
    )
    judged = asked.withColumn("outcome", outcome)
    refers = F.when(F.col("outcome") == "resolved", F.col("base.id"))
    judged = judged.withColumn("refers_to", refers).drop("base", "kind", "digest")
    # Full headers come by id for resolved revisits alone; equal ids of several responses give the least.
    bodies = rows.where((F.col("kind") == "response") & F.col("record_id").isNotNull()).select(
        F.col("record_id").alias("refers_to"), F.col("headers").alias("base_headers")
    )
    entries = F.array_sort(F.map_entries("base_headers"))
    bodies = bodies.groupBy("refers_to").agg(F.min(entries).alias("base_entries"))
    full = judged.join(bodies, "refers_to", "left")
    kept = lambda e: F.when(e["key"].isin(*UPDATED), F.coalesce(F.col("headers")[e["key"]], e["value"])).otherwise(e["value"])
    updated = F.transform("base_entries", lambda e: F.struct(e["key"].alias("key"), kept(e).alias("value")))
    names = F.transform("base_entries", lambda e: e["key"])
    added = F.filter(F.map_entries("headers"), lambda e: e["key"].isin(*UPDATED) & ~F.array_contains(names, e["key"]))
    merged = F.map_from_entries(F.concat(updated, added))
    return full.select(
        "record_id",
        "canonical_url",
        "time",
        "outcome",
        "refers_to",
        F.when(F.col("outcome") == "resolved", merged).otherwise(F.col("headers")).alias("headers"),
    )
