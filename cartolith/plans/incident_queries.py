"""Queries over metric samples, hypotheses and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.operators import incident
from cartolith.session import table

START, END = "2024-01-20 00:00:00", "2024-01-31 00:00:00"


def _window() -> tuple:
    return F.lit(START).cast("timestamp"), F.lit(END).cast("timestamp")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts of events by type."""
    return table(spark, folder, "events").groupBy(
        F.concat("event_type", F.lit("_total")).alias("metric"), F.date_trunc("hour", "ts").alias("ts")
    ).agg(F.count("*").alias("value"))


def gauges(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.concat("event_type", F.lit("_value")).alias("metric"), "ts", "value")


def i2_failure_spikes(spark: SparkSession, folder: str) -> DataFrame:
    return incident.failure_spikes(samples(spark, folder), *_window())


def i3_latency_spikes(spark: SparkSession, folder: str) -> DataFrame:
    return incident.latency_spikes(gauges(spark, folder), *_window())


def i4_saturation_spikes(spark: SparkSession, folder: str) -> DataFrame:
    return incident.saturation_spikes(gauges(spark, folder), *_window())


def i6_ranked_spikes(spark: SparkSession, folder: str) -> DataFrame:
    return incident.ranked_spikes(i2_failure_spikes(spark, folder), 3)


def _hypotheses(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "hypotheses").groupBy("investigation_id", "hyp_id").agg(
        F.max_by(F.struct("span_count", "anomaly_score"), F.struct("reported_at", "span_count", "anomaly_score")).alias("h")
    ).select("investigation_id", "hyp_id", "h.*")


def i9_initial_rank(spark: SparkSession, folder: str) -> DataFrame:
    return incident.fused_hypotheses(
        _hypotheses(spark, folder), {"span_count": 0.5, "anomaly_score": 0.5}, "investigation_id", "hyp_id"
    )


def _images(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Parts stand for pinned images by brand and name, suppliers' line items for running ones."""
    parts = table(spark, folder, "part")
    lines = table(spark, folder, "lineitem")
    image = F.concat_ws("/", "p_brand", "p_name")
    pinned = parts.select(image.alias("image"), F.col("p_size").cast("string").alias("tag"))
    runtime = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        image.alias("image"), F.col("l_quantity").cast("int").cast("string").alias("tag"),
        F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("container"),
    )
    return pinned, runtime


def j20_fleet_drift(spark: SparkSession, folder: str) -> DataFrame:
    pinned, runtime = _images(spark, folder)
    return incident.fleet_drift(pinned, runtime)


def w6_sibling_drift(spark: SparkSession, folder: str) -> DataFrame:
    return incident.sibling_drift(_images(spark, folder)[1])


def a24_spans_by_operation(spark: SparkSession, folder: str) -> DataFrame:
    """Events stand for spans; the type is the operation, the JSON properties are its tags."""
    spans = table(spark, folder, "events").select(
        F.col("event_type").alias("operation"), F.col("event_id").alias("seq"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("user"), F.col("user_id").cast("string")).alias("tags"),
    )
    return incident.spans_by_operation(spans, ("k", "user"))


def t10_by_status(spark: SparkSession, folder: str) -> DataFrame:
    return incident.by_status(j20_fleet_drift(spark, folder)).select("image", "source_tag", "live_tag", "status", "n", "place")


def r18_latest_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of hypotheses stand for notes about their subject."""
    rows = table(spark, folder, "hypotheses").groupBy("hyp_id").agg(F.max(F.struct("reported_at", "repo_key", "subject")).alias("v"))
    notes = rows.select(F.col("v.repo_key").alias("repo"), F.col("v.subject").alias("symbol"), F.col("hyp_id").alias("id"), F.col("v.reported_at").alias("at"))
    return incident.latest_notes(notes, 2).select("repo", "symbol", "id", "place")


def i5_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return incident.metrics_like(table(spark, folder, "events").select(F.concat("event_type", F.lit("_total")).alias("metric")), "^(?:c|s).*_total$")


def x18_repository_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Customers stand for repositories, their balance for stars; orders of a customer for hits."""
    hits = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    own = table(spark, folder, "customer").select(F.upper("c_name").alias("name"), F.col("c_acctbal").alias("stars"))
    return incident.repository_hits(hits.select(F.col("c_name").alias("name"), F.col("o_orderkey").alias("place")), own, 5000)


QUERIES = {
    "t10_by_status": t10_by_status,
    "r18_latest_notes": r18_latest_notes,
    "i5_metrics": i5_metrics,
    "x18_repository_hits": x18_repository_hits,
    "i2_failure_spikes": i2_failure_spikes,
    "i3_latency_spikes": i3_latency_spikes,
    "i4_saturation_spikes": i4_saturation_spikes,
    "i6_ranked_spikes": i6_ranked_spikes,
    "i9_initial_rank": i9_initial_rank,
    "j20_fleet_drift": j20_fleet_drift,
    "w6_sibling_drift": w6_sibling_drift,
    "a24_spans_by_operation": a24_spans_by_operation,
}

_SIDES = f"""
spans AS (SELECT TIMESTAMP '{START}' AS s, TIMESTAMP '{END}' AS e, TIMESTAMP '{START}' - INTERVAL 1 HOUR AS be,
                 TIMESTAMP '{START}' - INTERVAL 1 HOUR - (TIMESTAMP '{END}' - TIMESTAMP '{START}') AS bs),
sides AS (SELECT metric, value::DOUBLE AS value, CASE WHEN ts >= s AND ts < e THEN 1 WHEN ts >= bs AND ts < be THEN 0 END AS side FROM samples, spans),
both_ AS (SELECT metric, max(value) FILTER (side = 1) AS w, max(value) FILTER (side = 0) AS b FROM sides GROUP BY metric)
"""
_SAMPLES = "WITH samples AS (SELECT event_type || '_total' AS metric, date_trunc('hour', ts) AS ts, count(*) AS value FROM events GROUP BY ALL)," + _SIDES
_GAUGES = "WITH samples AS (SELECT event_type || '_value' AS metric, ts, value FROM events)," + _SIDES
_FAIL = "SELECT metric, round(w, 6) AS window_value, round(b, 6) AS baseline_value, round(w / b, 6) AS ratio, CASE WHEN b IS NULL OR b = 0 THEN 0.7 WHEN w / b > 5 THEN 1.0 WHEN w / b > 2 THEN 0.8 WHEN w / b > 1.2 THEN 0.6 ELSE 0.3 END::DOUBLE AS score FROM both_ WHERE w IS NOT NULL"
_IMAGES = """
WITH pinned AS (SELECT p_brand || '/' || p_name AS image, p_size::VARCHAR AS tag FROM part),
runtime AS (SELECT p_brand || '/' || p_name AS image, l_quantity::INT::VARCHAR AS tag, 'c' || l_orderkey AS container FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
SQL = {
    "r18_latest_notes": """WITH n AS (SELECT hyp_id AS id, max_by(repo_key, k) AS repo, max_by(subject, k) AS symbol, max(reported_at) AS t FROM (SELECT *, (reported_at, repo_key, subject) AS k FROM hypotheses) GROUP BY hyp_id)
      SELECT repo, symbol, id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo, symbol ORDER BY t DESC, id DESC) AS place FROM n) WHERE place <= 2""",
    "i5_metrics": "SELECT event_type || '_total' AS metric, count(*) AS samples FROM events WHERE regexp_matches(event_type || '_total', '^(?:c|s).*_total$') GROUP BY 1",
    "x18_repository_hits": """SELECT c_name AS name, c_acctbal AS stars, min(o_orderkey) AS place FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 5000 GROUP BY ALL""",
    "i2_failure_spikes": _SAMPLES + _FAIL,
    "i3_latency_spikes": _GAUGES + """, p AS (SELECT metric, quantile_disc(value, 0.99) FILTER (side = 1) AS w, quantile_disc(value, 0.99) FILTER (side = 0) AS b FROM sides GROUP BY metric)
        SELECT metric, w AS window_value, b AS baseline_value, round(w / b, 6) AS ratio, CASE WHEN w / b > 2 THEN 0.9 WHEN w / b > 1.5 THEN 0.7 ELSE 0.3 END::DOUBLE AS score FROM p WHERE w IS NOT NULL""",
    "i4_saturation_spikes": _GAUGES + "SELECT metric, round(w, 6) AS window_value, round(b, 6) AS baseline_value, round(w / b, 6) AS ratio, CASE WHEN w / b > 5 THEN 1.0 WHEN w / b > 2 THEN 0.8 WHEN w / b > 1.3 THEN 0.6 ELSE 0.3 END::DOUBLE AS score FROM both_ WHERE w IS NOT NULL",
    "i6_ranked_spikes": _SAMPLES + _FAIL + " ORDER BY score DESC, metric LIMIT 3",
    "i9_initial_rank": """
        WITH latest AS (SELECT investigation_id, hyp_id, coalesce(span_count::DOUBLE, 0) AS a, CASE WHEN anomaly_score IS NULL OR isnan(anomaly_score) THEN 0 ELSE anomaly_score END AS b
          FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id, hyp_id ORDER BY reported_at DESC, span_count DESC NULLS LAST, anomaly_score DESC NULLS LAST) AS rn FROM hypotheses) WHERE rn = 1),
        r AS (SELECT investigation_id, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM latest GROUP BY ALL)
        SELECT investigation_id, hyp_id, round(0.5 * CASE WHEN ha > la THEN (a - la) / (ha - la) ELSE 0 END + 0.5 * CASE WHEN hb > lb THEN (b - lb) / (hb - lb) ELSE 0 END, 6) AS score
        FROM latest JOIN r USING (investigation_id)""",
    "j20_fleet_drift": _IMAGES + """, a AS (SELECT image, tag, row_number() OVER (PARTITION BY image ORDER BY tag) AS rn FROM pinned),
        b AS (SELECT image, tag, row_number() OVER (PARTITION BY image ORDER BY tag) AS rn FROM runtime),
        z AS (SELECT coalesce(a.image, b.image) AS image, a.tag AS source_tag, b.tag AS live_tag,
              CASE WHEN a.tag IS NULL THEN 'only_runtime' WHEN b.tag IS NULL THEN 'only_source' WHEN a.tag = b.tag THEN 'same' ELSE 'drift' END AS status
              FROM a FULL JOIN b ON a.image = b.image AND a.rn = b.rn)
        SELECT image, source_tag, live_tag, status, count(*) AS n FROM z GROUP BY ALL""",
    "w6_sibling_drift": _IMAGES + "SELECT image, count(DISTINCT tag) AS tags, min(container) AS container FROM runtime GROUP BY image HAVING count(DISTINCT tag) > 1",
    "a24_spans_by_operation": """SELECT event_type AS operation, count(*) AS spans, min_by(json_extract_string(props, '$.k'), event_id) FILTER (json_extract_string(props, '$.k') <> '') AS k,
        min_by(user_id::VARCHAR, event_id) AS "user" FROM events GROUP BY event_type""",
}
SQL["t10_by_status"] = f"""SELECT *, row_number() OVER (PARTITION BY split_part(image, '/', 1) ORDER BY list_position(['drift', 'only_source', 'only_runtime', 'same'], status), image, source_tag NULLS FIRST, live_tag NULLS FIRST)::INT AS place
  FROM ({SQL['j20_fleet_drift']})"""
