"""Queries over snapshots and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from cartolith.operators import history
from cartolith.operators.snapshots import snapshot_changes
from cartolith.session import cut_lineage, table
from cartolith.sources.tables import COMMITS_SQL, ENTRIES_SQL, TOUCHES_SQL, commits, entries, files, touches


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols added, removed or changed and edges added or removed between consecutive snapshots."""
    return snapshot_changes(table(spark, folder, "code_graph_snapshots"))


#: The day from which recency is counted; queries never look at the clock.
AS_OF = "2002-01-01"


def g19_graph_summary(spark: SparkSession, folder: str) -> DataFrame:
    return history.graph_summary(p5_found(spark, folder))


def a10_churn(spark: SparkSession, folder: str) -> DataFrame:
    return history.churn(commits(spark, folder))


def w2_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    own = commits(spark, folder)
    size = own.groupBy("path").agg(F.sum("additions").cast("double").alias("complexity"))
    return history.hotspots(history.churn(own), size, limit=None)


def a11_coupled_files(spark: SparkSession, folder: str) -> DataFrame:
    return history.coupled_files(commits(spark, folder))


def j18_commit_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return history.coupled_files(commits(spark, folder), limit=None)


def a13_window_cochange(spark: SparkSession, folder: str) -> DataFrame:
    return history.window_cochange(touches(spark, folder))


def a30_reviewers(spark: SparkSession, folder: str) -> DataFrame:
    own = cut_lineage(commits(spark, folder), "commits")
    pairs = cut_lineage(history.coupled_files(own, limit=None).where(F.col("together") >= 2), "partners")
    partners = pairs.select("path", "other").unionByName(pairs.select(F.col("other").alias("path"), F.col("path").alias("other")))
    return history.reviewers(own, partners, F.lit(AS_OF).cast("timestamp"))


def a31_file_health(spark: SparkSession, folder: str) -> DataFrame:
    return history.file_health(commits(spark, folder))


def x16_recent_commits(spark: SparkSession, folder: str) -> DataFrame:
    return history.recent_commits(commits(spark, folder)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def z5_changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose stored time (that of their cached symbols' day) differs from the current one."""
    stored = entries(spark, folder).groupBy(F.col("repo_key").alias("repo"), F.regexp_replace("file", r"\\", "/").alias("path")).agg(
        F.date_trunc("day", F.max("cached_at")).alias("mod_time")
    )
    current = files(spark, folder).select("repo", "path", F.date_trunc("day", "mod_time").alias("mod_time"))
    return history.changed_files(stored, current)


def w5_newest_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return history.newest_snapshots(table(spark, folder, "code_graph_snapshots"))


QUERIES = {
    "p5_found": p5_found,
    "g19_graph_summary": g19_graph_summary,
    "a10_churn": a10_churn,
    "w2_hotspots": w2_hotspots,
    "a11_coupled_files": a11_coupled_files,
    "j18_commit_pairs": j18_commit_pairs,
    "a13_window_cochange": a13_window_cochange,
    "a30_reviewers": a30_reviewers,
    "a31_file_health": a31_file_health,
    "x16_recent_commits": x16_recent_commits,
    "z5_changed_files": z5_changed_files,
    "w5_newest_snapshots": w5_newest_snapshots,
}

_P5 = """
WITH held AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY received_at DESC) AS rn
    FROM code_graph_snapshots WHERE symbols IS NOT NULL OR edges IS NOT NULL) WHERE rn = 1),
linked AS (
  SELECT *, lag(snapshot_id) OVER w AS prev_id, lead(snapshot_id) OVER w AS next_id
  FROM held WINDOW w AS (PARTITION BY repo_key ORDER BY snapshot_at, snapshot_id)),
raw AS (
  SELECT snapshot_id, prev_id, next_id, 'symbol' AS item,
         coalesce(s.n, '') || ':' || coalesce(s.f, '') AS item_key, pos,
         {'k': s.k, 'c': s.c, 'x': coalesce(s.x, 0)} AS body
  FROM (SELECT snapshot_id, prev_id, next_id, unnest(symbols) AS s, generate_subscripts(symbols, 1) AS pos FROM linked)),
symbols AS (
  SELECT snapshot_id, prev_id, next_id, item, item_key, max_by(body, pos)::VARCHAR AS body
  FROM raw GROUP BY ALL),
edges AS (
  SELECT DISTINCT snapshot_id, prev_id, next_id, 'edge' AS item,
         coalesce(e.s, '') || '|' || coalesce(e.l, '') || '|' || coalesce(e.t, '') AS item_key, '' AS body
  FROM (SELECT snapshot_id, prev_id, next_id, unnest(edges) AS e FROM linked)),
elements AS (SELECT * FROM symbols UNION ALL SELECT * FROM edges),
now_side AS (SELECT snapshot_id, item, item_key, body FROM elements WHERE prev_id IS NOT NULL),
was_side AS (SELECT next_id AS snapshot_id, item, item_key, body FROM elements WHERE next_id IS NOT NULL)
SELECT snapshot_id, item, item_key,
       CASE WHEN w.body IS NULL THEN 'added' WHEN n.body IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM now_side n FULL JOIN was_side w USING (snapshot_id, item, item_key)
WHERE n.body IS DISTINCT FROM w.body
"""

_CHURN = "WITH " + COMMITS_SQL + """, churn AS (
  SELECT path, count(DISTINCT commit_id) AS commits, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions,
         round(count(DISTINCT commit_id) + (sum(additions) + sum(deletions)) / 100.0, 6)::DOUBLE AS score
  FROM commits GROUP BY path)
"""
_PAIRS = "WITH " + COMMITS_SQL + """, touched AS MATERIALIZED (SELECT DISTINCT commit_id, path FROM commits),
totals AS (SELECT path, count(*) AS n FROM touched GROUP BY path),
own AS (SELECT * FROM touched WHERE commit_id IN (SELECT commit_id FROM touched GROUP BY commit_id HAVING count(*) BETWEEN 2 AND 20)),
pairs AS MATERIALIZED (SELECT a.path, b.path AS other, count(*) AS together FROM own a JOIN own b ON a.commit_id = b.commit_id AND a.path < b.path GROUP BY ALL),
coupled AS (SELECT p.path, p.other, together, round(together / greatest(a.n, b.n), 6) AS ratio
            FROM pairs p JOIN totals a ON a.path = p.path JOIN totals b ON b.path = p.other)
"""
SQL = {
    "p5_found": _P5,
    "g19_graph_summary": f"""
SELECT snapshot_id, count(*) FILTER (item = 'symbol' AND change = 'added') AS symbols_added,
       count(*) FILTER (item = 'symbol' AND change = 'removed') AS symbols_removed,
       count(*) FILTER (item = 'symbol' AND change = 'changed') AS symbols_changed,
       count(*) FILTER (item = 'edge' AND change = 'added') AS edges_added,
       count(*) FILTER (item = 'edge' AND change = 'removed') AS edges_removed
FROM ({_P5}) GROUP BY snapshot_id""",
    "a10_churn": _CHURN + "SELECT * FROM churn",
    "w2_hotspots": _CHURN + """, both_ AS (SELECT path, score, additions::DOUBLE AS complexity FROM churn),
shares AS (SELECT path, (cume_dist() OVER (ORDER BY score)) * (cume_dist() OVER (ORDER BY complexity)) AS product FROM both_)
SELECT path, round(product, 9) AS hotspot, CASE WHEN product >= 0.81 THEN 'critical' WHEN product >= 0.64 THEN 'high' WHEN product >= 0.36 THEN 'medium' ELSE 'low' END AS band
FROM shares""",
    "a11_coupled_files": _PAIRS + "SELECT * FROM coupled ORDER BY together DESC, ratio DESC, path, other LIMIT 20",
    "j18_commit_pairs": _PAIRS + "SELECT * FROM coupled",
    "a13_window_cochange": "WITH " + TOUCHES_SQL + """,
bucketed AS MATERIALIZED (SELECT DISTINCT floor(epoch(ts) / 3600)::BIGINT AS bucket, repo, file FROM touches),
total AS (SELECT count(DISTINCT bucket) AS n FROM bucketed),
usual AS (SELECT repo, file, count(*) AS k, (SELECT n FROM total) AS n FROM bucketed GROUP BY ALL HAVING count(*) <= 0.85 * (SELECT n FROM total)),
kept AS MATERIALIZED (SELECT b.* FROM bucketed b JOIN usual USING (repo, file)),
pairs AS (SELECT x.repo AS repo_a, x.file AS file_a, y.repo AS repo_b, y.file AS file_b, count(*) AS co
          FROM kept x JOIN kept y ON x.bucket = y.bucket AND x.repo < y.repo GROUP BY ALL HAVING count(*) >= 3),
t AS (SELECT p.*, u.k::DOUBLE AS a, v.k::DOUBLE AS b, u.n::DOUBLE AS n FROM pairs p
      JOIN usual u ON u.repo = repo_a AND u.file = file_a JOIN usual v ON v.repo = repo_b AND v.file = file_b),
g AS (SELECT *, round(2 * (
        CASE WHEN co > 0 THEN co * ln(co / (a * b / n)) ELSE 0 END + CASE WHEN a - co > 0 THEN (a - co) * ln((a - co) / (a * (n - b) / n)) ELSE 0 END
      + CASE WHEN b - co > 0 THEN (b - co) * ln((b - co) / ((n - a) * b / n)) ELSE 0 END
      + CASE WHEN n - a - b + co > 0 THEN (n - a - b + co) * ln((n - a - b + co) / ((n - a) * (n - b) / n)) ELSE 0 END), 4) AS g2,
      co / least(a, b) AS p, least(a, b) AS m FROM t)
SELECT repo_a, file_a, repo_b, file_b, co, round(co * n / (a * b), 6) AS lift,
       round(((p + 3.8416 / (2 * m)) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * m)) / m)) / (1 + 3.8416 / m), 6) AS confidence, g2,
       CASE WHEN g2 >= 10.83 THEN 'very strong' WHEN g2 >= 6.63 THEN 'strong' WHEN g2 >= 3.84 THEN 'moderate' ELSE 'weak' END AS label
FROM g""",
    "a30_reviewers": _PAIRS + f""", partners AS (SELECT path, other FROM pairs WHERE together >= 2 UNION ALL SELECT other, path FROM pairs WHERE together >= 2),
mine AS MATERIALIZED (SELECT DISTINCT path, author, commit_id, ts FROM commits),
signals AS (SELECT path, author, 1.0::DOUBLE AS w FROM mine UNION ALL SELECT path, author, 0.4 FROM mine WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAYS
            UNION ALL SELECT p.path, m.author, 0.5 FROM partners p JOIN mine m ON m.path = p.other),
scored AS (SELECT path, author, round(sum(w), 6) AS score FROM signals GROUP BY ALL)
SELECT path, author, score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, author) AS place FROM scored) WHERE place <= 5""",
    "a31_file_health": "WITH " + COMMITS_SQL + """, r AS (
  SELECT path, count(DISTINCT CASE WHEN is_fix THEN commit_id END) AS fixes, count(DISTINCT commit_id) AS commits,
         sum(additions) + sum(deletions) AS changed, sum(additions) AS size FROM commits GROUP BY path),
s AS (SELECT *, least(greatest(ln(1 + fixes) / ln(21), 0), 1) AS defect, changed / greatest(size, 1) / 2 AS rel FROM r)
SELECT path, fixes, commits, (1 + round(round(9 * (0.6 * defect + 0.4 * CASE WHEN rel < 0.1 THEN 0 ELSE least(rel, 1) END), 6)))::INT AS health FROM s""",
    "x16_recent_commits": "WITH " + COMMITS_SQL + """
SELECT commit_id, author, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, count(DISTINCT path) AS files FROM commits
GROUP BY commit_id, author, commits.ts ORDER BY commits.ts DESC, commit_id DESC LIMIT 20""",
    "z5_changed_files": "WITH " + ENTRIES_SQL + r""",
stored AS (SELECT repo_key AS repo, replace(file, '\', '/') AS path, date_trunc('day', max(cached_at)) AS was FROM entries GROUP BY ALL),
current_ AS (SELECT repo_key AS repo, replace(file_path, '\', '/') AS path, date_trunc('day', max(mod_time)) AS now FROM source_files GROUP BY ALL)
SELECT repo, path, CASE WHEN s.repo IS NULL THEN 'new' WHEN c.repo IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM stored s FULL JOIN current_ c USING (repo, path) WHERE s.repo IS NULL OR c.repo IS NULL OR s.was IS DISTINCT FROM c.now""".replace("\\\\", "\\"),
    "w5_newest_snapshots": """
SELECT repo_key, snapshot_id, place::INT AS place FROM (
  SELECT repo_key, snapshot_id, row_number() OVER (PARTITION BY repo_key ORDER BY snapshot_at DESC, snapshot_id DESC) AS place
  FROM (SELECT DISTINCT repo_key, snapshot_id, snapshot_at FROM code_graph_snapshots)) WHERE place <= 5""",
}
