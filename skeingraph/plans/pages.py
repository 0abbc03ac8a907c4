"""Queries: addresses and links of web pages, and moments of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times, urls
from .registering import registrar

QUERIES, ORACLES, query = registrar()

_SPLIT = r"regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?', ['scheme', 'authority', 'path', 'query', 'fragment'])"
_PARTS = f"p AS MATERIALIZED (SELECT page_id, html, lower(u.scheme) AS scheme, regexp_extract(lower(u.authority), '^(?:[^@]*@)?([^:]*)', 1) AS host, regexp_extract(u.authority, ':(\\d+)$', 1) AS port, u.path, u.query, u.fragment FROM (SELECT page_id, html, {_SPLIT} AS u FROM pages))"
_NORMAL = "scheme || '://' || regexp_replace(host, '^www\\.', '') || CASE WHEN port = '' OR (scheme, port) IN (('http', '80'), ('https', '443')) THEN '' ELSE ':' || port END || regexp_replace(regexp_replace({path}, '/index\\.html?$', '/'), '/+$', '') || {query}"
_ASKED = "coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&'), ''), '')"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


@query(f"WITH {_PARTS} SELECT page_id, scheme, host, port, path, query, fragment FROM p")
def url_parts(spark, d):
    return _pages(spark, d).select("page_id", urls.parts(F.col("url")).alias("u")).select("page_id", "u.*")


@query(f"WITH {_PARTS} SELECT page_id, url_decode(replace(string_split(x, '=')[1], '+', ' ')) AS name, url_decode(replace(regexp_extract(x, '=(.*)$', 1), '+', ' ')) AS value FROM (SELECT page_id, unnest(string_split(query, '&')) AS x FROM p) WHERE regexp_matches(x, '=.')")
def url_parameters(spark, d):
    """Names and values of all queries."""
    rows = _pages(spark, d).select("page_id", F.explode(urls.parameters(urls.query(F.col("url")))).alias("x"))
    return rows.select("page_id", "x.name", "x.value")


@query(f"WITH {_PARTS} SELECT {_NORMAL.format(path='path', query=_ASKED)} AS url, count(*) AS n, min(page_id) AS first_page FROM p GROUP BY 1")
def same_pages(spark, d):
    """Pages by the normal form of their address."""
    return _pages(spark, d).groupBy(urls.normal(F.col("url")).alias("url")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(
    f"""WITH {_PARTS}, own AS (SELECT DISTINCT host, {_NORMAL.format(path='path', query=_ASKED)} AS url FROM p), n AS (SELECT host, count(*) AS pages FROM p GROUP BY 1),
    l AS (SELECT scheme, host, port, path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM p),
    t AS (SELECT host, CASE WHEN starts_with(link, '/') THEN {_NORMAL.format(path="regexp_extract(link, '^[^?#]*')", query="''")} ELSE {_NORMAL.format(path="regexp_replace(path, '[^/]*$', '') || regexp_extract(link, '^[^?#]*')", query="''")} END AS url FROM l)
    SELECT n.host, pages, coalesce(links, 0) AS links, coalesce(targets, 0) AS targets, coalesce(known, 0) AS known FROM n LEFT JOIN (SELECT t.host, count(*) AS links, count(DISTINCT t.url) AS targets, count(*) FILTER (o.url IS NOT NULL) AS known FROM t LEFT JOIN (SELECT DISTINCT url FROM own) o ON t.url = o.url GROUP BY 1) USING (host)"""
)
def links_by_host(spark, d):
    """Of each host its pages, its links, how many different addresses they lead to, and how many links lead to a page that is there.

    Links are counted by host and address before they are joined, so a link that every page has is one row a host.
    """
    p = _pages(spark, d).withColumn("host", urls.host(F.col("url")))
    links = p.select("host", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))
    to = links.groupBy("host", urls.normal(urls.resolved(F.col("url"), F.col("link"))).alias("to")).agg(F.count("*").alias("n"))
    there = p.select(urls.normal(F.col("url")).alias("to"), F.lit(True).alias("known")).distinct()
    per = to.join(there, "to", "left").groupBy("host").agg(F.sum("n").alias("links"), F.count("*").alias("targets"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("known"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return p.groupBy("host").agg(F.count("*").alias("pages")).join(per, "host", "left").select("host", "pages", none("links"), none("targets"), none("known"))


@query(
    """WITH e AS (SELECT event_id, ts, CAST(floor(epoch_us((SELECT max(ts) FROM events)) / 1e6 - epoch_us(ts) / 1e6) AS BIGINT) AS s FROM events), u AS (SELECT *, CASE WHEN s >= 86400 THEN s // 86400 WHEN s >= 3600 THEN s // 3600 WHEN s >= 60 THEN s // 60 ELSE s END AS k, CASE WHEN s >= 86400 THEN 'day' WHEN s >= 3600 THEN 'hour' WHEN s >= 60 THEN 'minute' ELSE 'second' END AS unit FROM e)
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS iso, 'conversation-' || strftime(ts, '%Y%m%d-%H%M%S') AS saved, epoch_us(ts) / 1e6 AS seconds, CASE WHEN s <= 0 THEN 'now' ELSE k || ' ' || unit || CASE WHEN k = 1 THEN ' ago' ELSE 's ago' END END AS age FROM u"""
)
def event_times(spark, d):
    """Each event's moment as text, as a name and as seconds, and how long it was before the last one."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts")
    last = e.agg(F.max("ts").alias("_last"))  # one row
    rows = e.crossJoin(F.broadcast(last))
    return rows.select("event_id", times.iso(F.col("ts")).alias("iso"), times.saved_name(F.col("ts"), "conversation").alias("saved"), times.epoch_seconds(F.col("ts")).alias("seconds"), times.age(F.col("ts"), F.col("_last")).alias("age"))
