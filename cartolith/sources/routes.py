"""Routes named in texts: links give client and server sides, query parameters stand for hooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.session import table

LINK = r"https?://[^/\s]+(/[^\s?#]*)(?:\?q=(\w+))?"
SERVER_SOURCES = ("readme", "design", "adr", "runbook")


def normal_route(path: Column) -> Column:
    """Without scheme and host, ``:x``, ``{x}`` and numbers as ``*``, single slashes, none at the end."""
    p = F.regexp_replace(path, r"^[a-zA-Z]+://[^/]+", "")
    p = F.regexp_replace(p, r":\w+|\{[^}]*\}|(?<=/)[0-9]+(?=/|$)", "*")
    p = F.regexp_replace(p, r"/{2,}", "/")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def routes(spark: SparkSession, folder: str) -> DataFrame:
    """``symbol, file, method, path, hook, side, framework``, one row per link and document."""
    docs = table(spark, folder, "documents").where(F.col("text").isNotNull())
    source = F.coalesce("source", F.lit("none"))
    links = docs.select(
        source.alias("symbol"),
        F.coalesce("path", F.lit("")).alias("file"),
        F.when(source.isin(*SERVER_SOURCES), "server").otherwise("client").alias("side"),
        F.explode(F.regexp_extract_all("text", F.lit(LINK), F.lit(0))).alias("url"),
    )
    return links.select(
        "symbol", "file", F.lit("GET").alias("method"), normal_route(F.regexp_extract("url", LINK, 1)).alias("path"),
        F.regexp_extract("url", LINK, 2).alias("hook"), "side",
    ).distinct()


ROUTES_SQL = r"""
routes AS MATERIALIZED (
  SELECT DISTINCT symbol, file, 'GET' AS method,
         CASE WHEN length(p) > 1 THEN regexp_replace(p, '/$', '') ELSE p END AS path, hook, side
  FROM (SELECT symbol, file, side, regexp_extract(url, 'q=(\w+)', 1) AS hook,
               regexp_replace(regexp_replace(regexp_extract(url, 'https?://[^/\s]+(/[^\s?#]*)', 1), '/[0-9]+(/|$)', '/*\1', 'g'), '/{2,}', '/', 'g') AS p
        FROM (SELECT coalesce(source, 'none') AS symbol, coalesce(path, '') AS file,
                     CASE WHEN source IN ('readme', 'design', 'adr', 'runbook') THEN 'server' ELSE 'client' END AS side,
                     unnest(regexp_extract_all(text, 'https?://[^/\s]+/[^\s?#]*(?:\?q=\w+)?')) AS url
              FROM documents WHERE text IS NOT NULL)))
"""


def hooks(found: DataFrame) -> DataFrame:
    """The hook-like routes: path is the hook's name."""
    return found.where(F.col("hook") != "").select(
        "symbol", "file", "method", F.col("hook").alias("path"), "side", F.lit("wordpress").alias("framework")
    ).distinct()


HOOKS_SQL = "hooks AS (SELECT DISTINCT symbol, file, method, hook AS path, side FROM routes WHERE hook <> '')"
