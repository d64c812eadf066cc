"""Adapters from the given tables to the tables the operators work on, each with the same adapter in SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.operators.snapshots import valid_snapshots
from cartolith.session import broadcast_if_bounded, cut_lineage, table


@dataclass(frozen=True)
class Graph:
    """Typed property graphs side by side, told apart by ``graph``.

    ``symbols``: graph, repo, name, file, kind, community, complexity.
    ``edges``: graph, label, src, src_file, dst, dst_file.
    A symbol is (graph, name, file); containment in files follows from ``file``.
    """

    symbols: DataFrame
    edges: DataFrame

    def calls(self) -> DataFrame:
        return self.edges.where(F.col("label") == "CALLS")


def package_of(file: Column) -> Column:
    """The folder of a file, ``.`` at the root."""
    return F.when(F.instr(file, "/") > 0, F.regexp_replace(file, r"/[^/]*$", "")).otherwise(".")


def snapshot_graphs(spark: SparkSession, folder: str, stage: bool = False) -> Graph:
    """One graph per valid snapshot; of an element repeated within an array the last one holds.

    The deliveries that hold are few columns and are broadcast if bounded, so
    that nested arrays are not shuffled; rows repeated whole fall together when
    their elements do.  ``stage`` writes both tables once, for operators that
    read them several times.
    """
    raw = table(spark, folder, "code_graph_snapshots")
    held = cut_lineage(valid_snapshots(raw).select("snapshot_id", "received_at").distinct(), "held-snapshots")
    rows = raw.join(broadcast_if_bounded(held), ["snapshot_id", "received_at"])
    symbols = (
        rows.select(F.col("snapshot_id").alias("graph"), "repo_key", F.posexplode("symbols").alias("pos", "s"))
        .groupBy("graph", F.col("repo_key").alias("repo"), F.col("s.n").alias("name"), F.col("s.f").alias("file"))
        .agg(F.max_by(F.struct("s.k", "s.c", "s.x"), "pos").alias("v"))
        .select(
            "graph", "repo", "name", "file", F.col("v.k").alias("kind"), F.col("v.c").alias("community"),
            F.coalesce("v.x", F.lit(0)).alias("complexity"),
        )
    )
    edges = rows.select(F.col("snapshot_id").alias("graph"), F.explode("edges").alias("e")).select(
        "graph",
        F.col("e.l").alias("label"),
        F.substring_index("e.s", ":", 1).alias("src"),
        F.regexp_replace("e.s", "^[^:]*:", "").alias("src_file"),
        F.substring_index("e.t", ":", 1).alias("dst"),
        F.regexp_replace("e.t", "^[^:]*:", "").alias("dst_file"),
    ).distinct()
    if stage:
        symbols, edges = cut_lineage(symbols, "graph-symbols"), cut_lineage(edges, "graph-edges")
    return Graph(symbols, edges)


GRAPH_SQL = """
held AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY received_at DESC) AS rn
                 FROM code_graph_snapshots WHERE symbols IS NOT NULL OR edges IS NOT NULL) WHERE rn = 1),
symbols AS MATERIALIZED (
  SELECT graph, repo, name, file, max_by(k, pos) AS kind, max_by(c, pos) AS community, max_by(x, pos) AS complexity FROM (
    SELECT snapshot_id AS graph, repo_key AS repo, s.n AS name, s.f AS file, pos, s.k AS k, s.c AS c, coalesce(s.x, 0) AS x
    FROM (SELECT snapshot_id, repo_key, unnest(symbols) AS s, generate_subscripts(symbols, 1) AS pos FROM held))
  GROUP BY ALL),
edges AS MATERIALIZED (
  SELECT DISTINCT snapshot_id AS graph, e.l AS label, split_part(e.s, ':', 1) AS src, regexp_replace(e.s, '^[^:]*:', '') AS src_file,
         split_part(e.t, ':', 1) AS dst, regexp_replace(e.t, '^[^:]*:', '') AS dst_file
  FROM (SELECT snapshot_id, unnest(edges) AS e FROM held)),
calls AS MATERIALIZED (SELECT * FROM edges WHERE label = 'CALLS')
"""


def package_sql(file: str) -> str:
    return f"(CASE WHEN instr({file}, '/') > 0 THEN regexp_replace({file}, '/[^/]*$', '') ELSE '.' END)"


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """``commit_id, author, ts, path, additions, deletions, is_fix``: orders stand for commits, their lines for changed files."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("commit_id"),
        F.concat(F.lit("dev"), F.col("o_custkey").cast("string")).alias("author"),
        F.col("o_orderdate").alias("ts"),
        F.concat(F.lit("sym"), F.col("l_partkey").cast("string")).alias("path"),
        F.col("l_quantity").cast("bigint").alias("additions"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("deletions"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_fix"),
    )


COMMITS_SQL = """
commits AS (
  SELECT o_orderkey AS commit_id, 'dev' || o_custkey AS author, o_orderdate AS ts, 'sym' || l_partkey AS path,
         l_quantity::BIGINT AS additions, round(l_discount * 100)::BIGINT AS deletions, o_orderpriority = '1-URGENT' AS is_fix
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
"""


def touches(spark: SparkSession, folder: str) -> DataFrame:
    """``repo, file, ts``: events stand for touched files, a user's for those of one file, their types for repositories."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("repo"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), "ts"
    )


TOUCHES_SQL = "touches AS (SELECT event_type AS repo, 'u' || user_id AS file, ts FROM events)"


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """Symbol entries, rows repeated whole taken once."""
    return table(spark, folder, "symbol_entries").dropDuplicates(["entry_id"])


ENTRIES_SQL = "entries AS MATERIALIZED (SELECT DISTINCT ON (entry_id) * FROM symbol_entries)"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``repo, path, language, size, lines, mod_time, content``: the newest row of each source file."""
    raw = table(spark, folder, "source_files")
    newest = raw.groupBy("repo_key", "file_path").agg(
        F.max(F.struct("mod_time", "language", "size_bytes", "line_count", "content")).alias("v")
    )
    return newest.select(
        F.col("repo_key").alias("repo"),
        F.regexp_replace("file_path", r"\\", "/").alias("path"),
        F.lower(F.nullif(F.col("v.language"), F.lit(""))).alias("language"),
        F.col("v.size_bytes").alias("size"),
        F.col("v.line_count").alias("lines"),
        F.col("v.mod_time").alias("mod_time"),
        F.col("v.content").alias("content"),
    )


FILES_SQL = r"""
files AS MATERIALIZED (
  SELECT repo_key AS repo, replace(file_path, '\', '/') AS path, lower(nullif(language, '')) AS language,
         size_bytes AS size, line_count AS lines, mod_time, content
  FROM (SELECT *, row_number() OVER (PARTITION BY repo_key, file_path
               ORDER BY mod_time DESC NULLS LAST, language DESC NULLS LAST, size_bytes DESC NULLS LAST,
                        line_count DESC NULLS LAST, content DESC NULLS LAST) AS rn FROM source_files) WHERE rn = 1)
"""
