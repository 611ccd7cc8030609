"""Not-modified revisits of a web archive, resolved to the response they confirm.

A revisit says that a page had not changed: it has headers but no payload. It takes the payload of the
latest earlier full response of the same canonical URL, if their validators agree, and the response's
headers updated by those that a not-modified answer may change.

The as-of step works on rows ordered by (URL, time), cut into slices of like size, so a URL with a third
of all captures spreads over many tasks; the last response of a slice reaches the later ones through a
table with two rows a slice. Payloads are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.llm.registry import query, table
from tenderlens.operators.ordering import sliced

# Query parameters that only track; headers that a 304 answer may update.
TRACKING = r"^(utm_.*|ref|fbclid|gclid)(=.*)?$"
UPDATED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")


def canonical_url(url: Column) -> Column:
    """Without scheme, user, default port, leading www, fragment, tracking and closing slash; query sorted."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    before = F.regexp_extract(plain, r"^([^?]*)", 1)
    host = F.lower(F.regexp_extract(before, r"^([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(before, r"^[^/]*(.*)$", 1), "/+$", "")
    asked = F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(asked, lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(F.length(host) > 0, F.concat(
        host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, updated by the permitted ones of the newer answer."""
    allowed = F.map_filter(fresh, lambda k, v: k.isin(*UPDATED) & v.isNotNull())
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, response_id, outcome, headers, payload_digest.

    ``records`` holds record_id, url, at (a number or timestamp), kind ('response' or 'revisit'), headers (map
    with lower-case names) and payload_digest; other columns are not read. Outcomes: ``resolved``; ``conflict``
    if the validators of the latest earlier response contradict the revisit (etag if both have one, else
    last-modified if both have one) or the two share no validator; ``orphan`` if there is no earlier response. Of responses
    at one time the one with the largest id is the latest; a response at the revisit's own time is not earlier.
    Rows without URL or time are neither resolved nor used, null headers count as none; repeated rows are
    each resolved; an empty table gives no rows.
    """
    no_headers = F.create_map().cast("map<string,string>")
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "at", "kind",
        F.coalesce("headers", no_headers).alias("headers"), "payload_digest")
    usable = rows.filter("url_key IS NOT NULL AND at IS NOT NULL AND kind IN ('response', 'revisit')")
    is_response = F.col("kind") == "response"
    full = F.when(is_response, F.struct("record_id", "headers", "payload_digest"))
    ordered = usable.withColumn("rank", is_response.cast("int")).withColumn("full", full)
    cut = sliced(ordered, ["url_key", "at", "rank", "record_id"])
    within = Window.partitionBy("_slice", "url_key").orderBy("_offset").rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("near", F.last("full", ignorenulls=True).over(within))

    ends = cut.groupBy("_slice").agg(F.min("url_key").alias("head"), F.max("url_key").alias("tail"))
    tails = cut.join(ends, "_slice").filter((F.col("url_key") == F.col("tail")) & is_response).groupBy("_slice").agg(
        F.max_by("full", "_offset").alias("full"))
    marks = ends.select("_slice", F.col("head").alias("url_key"), F.lit(0).alias("step"),
                        F.lit(None).cast(cut.schema["full"].dataType).alias("full")).unionByName(
        ends.join(tails, "_slice").select("_slice", F.col("tail").alias("url_key"), F.lit(1).alias("step"), "full"))
    earlier = Window.partitionBy("url_key").orderBy("_slice", "step").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("far", F.last("full", ignorenulls=True).over(earlier)).filter("step = 0 AND far IS NOT NULL")
    asked = local.filter("kind = 'revisit'").join(carried.select("_slice", "url_key", "far"), ["_slice", "url_key"], "left")
    found = asked.withColumn("response", F.coalesce("near", "far"))

    def check(name: str) -> Column:
        return opaque(F.col("response.headers")[name]) == opaque(F.col("headers")[name])

    agrees = F.coalesce(check("etag"), check("last-modified"), F.lit(False))
    outcome = F.when(F.col("response").isNull(), "orphan").when(agrees, "resolved").otherwise("conflict")
    judged = found.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    out = judged.select(
        "record_id", "url_key", F.col("response.record_id").alias("response_id"), "outcome",
        F.when(resolved, merged_headers(F.col("response.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(resolved, F.col("response.payload_digest")).alias("payload_digest"))
    lost = rows.filter("kind = 'revisit' AND (url_key IS NULL OR at IS NULL)").select(
        "record_id", "url_key", F.lit(None).cast(records.schema["record_id"].dataType).alias("response_id"),
        F.lit("orphan").alias("outcome"), "headers", F.lit(None).cast("string").alias("payload_digest"))
    return out.unionByName(lost)


def opaque(validator: Column) -> Column:
    """A validator without blanks around it and without the mark of a weak one: not-modified answers compare weakly."""
    return F.regexp_replace(F.trim(validator), "^W/", "")


def capture_log(pages: DataFrame) -> DataFrame:
    """Archive records of the pages: each is fetched in full and asked for again later, as its id tells.

    Every fifth revisit carries another etag, every seventh none but a date, every ninth no validator; every
    eleventh was made before its page was fetched.
    """
    i = F.col("page_id")
    tag, day = F.md5("html"), F.concat(F.lit("day "), (i % 97).cast("string"))

    def headers(**named: Column) -> Column:
        parts = [x for name, value in named.items() for x in (F.lit(name.replace("_", "-")), value)]
        return F.map_filter(F.create_map(*parts), lambda k, v: v.isNotNull())

    response = pages.select(
        (2 * i).alias("record_id"), "url", (i * 10).alias("at"), F.lit("response").alias("kind"),
        headers(content_type=F.lit("text/html"), content_length=F.length("html").cast("string"), etag=tag,
                last_modified=day, date=(i * 10).cast("string"), cache_control=F.lit("max-age=60")).alias("headers"),
        F.sha2("html", 256).alias("payload_digest"))
    bare = (i % 9 == 0)
    revisit = pages.select(
        (2 * i + 1).alias("record_id"), "url",
        F.when(i % 11 == 0, i * 10 - 3).otherwise(i * 10 + 5).alias("at"), F.lit("revisit").alias("kind"),
        headers(content_length=F.lit("0"), date=(i * 10 + 5).cast("string"), set_cookie=F.lit("a=b"),
                cache_control=F.when(i % 2 == 0, F.lit("no-cache")),
                etag=F.when(~bare & (i % 7 != 0), F.when(i % 5 == 0, F.md5(F.concat("html", F.lit("*")))).otherwise(tag)),
                last_modified=F.when(~bare & (i % 7 == 0), day)).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"))
    return response.unionByName(revisit)


_SQL = r"""
WITH parts AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS plain
  FROM pages),
cut AS (
  SELECT *, regexp_extract(plain, '^([^?]*)', 1) AS before, list_sort(list_filter(
    string_split(regexp_extract(plain, '\?(.*)$', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_.*|ref|fbclid|gclid)(=.*)?$'))) AS asked FROM parts),
hosts AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(before, '^([^/]*)', 1)),
    '^.*@', ''), ':(80|443)$', ''), '^www\.', '') AS host FROM cut),
keyed AS (
  SELECT page_id AS i, html, CASE WHEN length(host) > 0 THEN host || regexp_replace(regexp_extract(before, '^[^/]*(.*)$', 1), '/+$', '')
    || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS url_key FROM hosts),
responses AS (
  SELECT 2 * i AS response_id, url_key, i * 10 AS at, md5(html) AS etag, 'day ' || (i % 97) AS last_modified,
         length(html)::VARCHAR AS content_length, sha256(html) AS payload_digest FROM keyed),
revisits AS (
  SELECT 2 * i + 1 AS record_id, url_key, CASE WHEN i % 11 = 0 THEN i * 10 - 3 ELSE i * 10 + 5 END AS at,
         (i * 10 + 5)::VARCHAR AS date, CASE WHEN i % 2 = 0 THEN 'no-cache' END AS cache_control,
         CASE WHEN i % 9 <> 0 AND i % 7 <> 0 THEN CASE WHEN i % 5 = 0 THEN md5(html || '*') ELSE md5(html) END END AS etag,
         CASE WHEN i % 9 <> 0 AND i % 7 = 0 THEN 'day ' || (i % 97) END AS last_modified FROM keyed),
matched AS (
  SELECT v.*, r.response_id, r.etag AS old_etag, r.last_modified AS old_modified, r.content_length AS old_length,
         r.payload_digest AS old_digest,
         CASE WHEN r.response_id IS NULL THEN 'orphan'
              WHEN coalesce(r.etag = v.etag, r.last_modified = v.last_modified, false) THEN 'resolved' ELSE 'conflict' END AS outcome
  FROM revisits v ASOF LEFT JOIN responses r ON v.url_key = r.url_key AND v.at > r.at)
SELECT record_id, url_key, response_id, outcome,
       CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type,
       CASE WHEN outcome = 'resolved' THEN old_length ELSE '0' END AS content_length,
       CASE WHEN outcome = 'resolved' THEN coalesce(etag, old_etag) ELSE etag END AS etag,
       CASE WHEN outcome = 'resolved' THEN coalesce(cache_control, 'max-age=60') ELSE cache_control END AS cache_control,
       date, CASE WHEN outcome = 'resolved' THEN old_digest END AS payload_digest
FROM matched
"""


@query("op4_warc_revisits", _SQL)
def op4_warc_revisits(spark, sf_dir):
    found = resolve_revisits(capture_log(table(spark, sf_dir, "pages")))
    return found.select("record_id", "url_key", "response_id", "outcome", *[
        F.col("headers")[name].alias(name.replace("-", "_"))
        for name in ("content-type", "content-length", "etag", "cache-control", "date")], "payload_digest")
