"""Queries of the scanners over source files, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions.predicates import TEST_FILE, is_test_file
from cartolith.session import table
from cartolith.operators import graph_templates as gt
from cartolith.sources import scanners, sinks
from cartolith.sources.tables import ENTRIES_SQL, FILES_SQL, GRAPH_SQL, entries, files, package_of, package_sql, snapshot_graphs
from cartolith.streaming import changes


def s7_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return scanners.extract_symbols(files(spark, folder))


def s7_imports(spark: SparkSession, folder: str) -> DataFrame:
    return scanners.import_rows(files(spark, folder))


def s6_calls(spark: SparkSession, folder: str) -> DataFrame:
    return scanners.call_rows(files(spark, folder))


def s6_type_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Classes made of the type edges of the graphs, read back."""
    up = snapshot_graphs(spark, folder).edges.where(F.col("label").isin("INHERITS", "IMPLEMENTS"))
    word = F.when(F.col("label") == "INHERITS", "extends").otherwise("implements")
    line = F.concat(F.lit("class "), "src", F.lit(" "), word, F.lit(" "), "dst", F.lit(" {}"))
    code = up.groupBy(F.col("graph").alias("repo"), F.col("src_file").alias("path")).agg(F.array_join(F.collect_set(line), "\n").alias("content"))
    return scanners.type_relations(code).select(F.col("repo").cast("bigint").alias("repo"), "file", "subject", "target", "kind")


def s21_sections(spark: SparkSession, folder: str) -> DataFrame:
    return scanners.document_sections(table(spark, folder, "documents")).select("doc_id", "section", "title")


def z7_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """The streaming query over a static table: same plan, watermark without effect."""
    events = table(spark, folder, "events").select(F.col("event_type").alias("key"), "ts")
    return changes.tumbling_counts(events).withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss"))


KEY = ["repo_key", "file_path", "symbol_name"]


def _versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Embedding rows: the first version of each key as stored, all others as a batch."""
    rows = table(spark, folder, "code_embeddings").select(*KEY, "vec_id", F.struct("updated_at", "vec_id").alias("version"))
    first = rows.groupBy(*KEY).agg(F.min("version").alias("v")).select(*KEY, F.col("v.vec_id").alias("vec_id"), F.col("v").alias("version"))
    keys = F.xxhash64(*KEY, "version")
    return first, rows.join(first.select(keys.alias("_k")), keys == F.col("_k"), "left_anti")


def k3_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Embedding rows in their latest version: later versions laid over the first ones."""
    stored, batch = _versions(spark, folder)
    return changes.upserted(stored, batch, KEY, "version").select(*KEY, "vec_id")


def k4_updated(spark: SparkSession, folder: str) -> DataFrame:
    """First versions with the greatest vec_id of the batch as their new value."""
    stored, batch = _versions(spark, folder)
    keyed = [x.select(*[F.coalesce(c, F.lit("")).alias(c) for c in KEY], "vec_id") for x in (stored, batch)]
    return sinks.updated(*keyed, KEY)


def u5_without_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Embedding rows of files that source_files has."""
    owners = table(spark, folder, "source_files").select("repo_key", "file_path")
    return sinks.without_orphans(table(spark, folder, "code_embeddings"), owners, ["repo_key", "file_path"]).select("vec_id").distinct()


def a29_table_counts(spark: SparkSession, folder: str) -> DataFrame:
    owners = table(spark, folder, "source_files").select("repo_key", "file_path")
    return sinks.table_counts(table(spark, folder, "code_embeddings"), owners, "repo_key", ["repo_key", "file_path"])


def z4_file_changes(spark: SparkSession, folder: str) -> DataFrame:
    """What the vectors of symbols need, given the entries and the files that are no tests."""
    stored = table(spark, folder, "code_embeddings").where("repo_key IS NOT NULL AND file_path IS NOT NULL AND symbol_name IS NOT NULL")
    stored = stored.select(F.col("repo_key").alias("repo"), F.col("file_path").alias("file"), F.col("symbol_name").alias("name"), F.col("body_hash").alias("hash"))
    own = entries(spark, folder).where("repo_key IS NOT NULL AND file IS NOT NULL AND name IS NOT NULL")
    current = own.select(F.col("repo_key").alias("repo"), "file", "name", F.col("body_hash").alias("hash"))
    there = table(spark, folder, "source_files").select(F.col("repo_key").alias("repo"), F.col("file_path").alias("file"), (~is_test_file(F.col("file_path"))).alias("usable"))
    return changes.file_changes(stored, current, there)


def _package_edges(spark: SparkSession, folder: str) -> DataFrame:
    used = gt.imports(snapshot_graphs(spark, folder))
    return used.select("graph", package_of(F.col("file")).alias("src"), F.col("package").alias("dst")).distinct()


def k6_dot(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.dot_text(_package_edges(spark, folder))


def k6_mermaid(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.mermaid_text(_package_edges(spark, folder))


def k6_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Complex functions as findings, one report a language."""
    own = entries(spark, folder).where("complexity >= 6 AND file IS NOT NULL AND name IS NOT NULL")
    level = F.when(F.col("complexity") >= 10, "high").otherwise("medium")
    rows = own.select(F.coalesce("language", F.lit("none")).alias("rule"), level.alias("level"), F.col("name").alias("message"), "file", F.coalesce("start_line", F.lit(0)).alias("line"))
    return sinks.findings_report(rows, "complexity")


def x22_tree(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.tree_text(files(spark, folder).where("repo IS NOT NULL AND path IS NOT NULL"), 50)


def x21_skeletons(spark: SparkSession, folder: str) -> DataFrame:
    symbols = entries(spark, folder).select(F.col("repo_key").alias("repo"), F.regexp_replace("file", r"\\", "/").alias("file"), "start_line", "end_line", "signature")
    return sinks.skeletons(files(spark, folder), symbols)


QUERIES = {
    "s7_symbols": s7_symbols,
    "s7_imports": s7_imports,
    "s6_calls": s6_calls,
    "s6_type_relations": s6_type_relations,
    "s21_sections": s21_sections,
    "z7_tumbling": z7_tumbling,
    "k3_upsert": k3_upsert,
    "k4_updated": k4_updated,
    "z4_file_changes": z4_file_changes,
    "u5_without_orphans": u5_without_orphans,
    "a29_table_counts": a29_table_counts,
    "k6_dot": k6_dot,
    "k6_mermaid": k6_mermaid,
    "k6_findings": k6_findings,
    "x22_tree": x22_tree,
    "x21_skeletons": x21_skeletons,
}

_VERSIONS = "v AS (SELECT DISTINCT repo_key, file_path, symbol_name, vec_id, updated_at, row_number() OVER (PARTITION BY repo_key, file_path, symbol_name ORDER BY updated_at, vec_id) AS rn FROM (SELECT DISTINCT repo_key, file_path, symbol_name, vec_id, updated_at FROM code_embeddings))"
_EDGES = f"{GRAPH_SQL}, e AS (SELECT DISTINCT graph, {package_sql('src_file')} AS src, {package_sql('dst_file')} AS dst FROM edges WHERE {package_sql('src_file')} <> {package_sql('dst_file')})"
SQL = {
    "z4_file_changes": "WITH " + ENTRIES_SQL + f""", o AS (SELECT repo_key AS repo, file_path AS file, symbol_name AS name, max(body_hash) AS was FROM code_embeddings WHERE repo_key IS NOT NULL AND file_path IS NOT NULL AND symbol_name IS NOT NULL GROUP BY ALL),
      n AS (SELECT repo_key AS repo, file, name, max(body_hash) AS now FROM entries e WHERE name IS NOT NULL AND EXISTS (SELECT 1 FROM source_files s WHERE s.repo_key = e.repo_key AND s.file_path = e.file AND NOT regexp_matches(s.file_path, '{TEST_FILE.replace("'", "''")}')) GROUP BY ALL)
      SELECT * FROM (SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.file, n.file) AS file, coalesce(o.name, n.name) AS name,
        CASE WHEN n.repo IS NULL THEN 'remove' WHEN o.repo IS NULL THEN 'add' WHEN NOT coalesce(was = now AND now <> 0, false) THEN 'update' END AS action
        FROM o FULL JOIN n ON o.repo = n.repo AND o.file = n.file AND o.name = n.name) WHERE action IS NOT NULL""",
    "s6_type_relations": "WITH " + GRAPH_SQL + " SELECT DISTINCT graph AS repo, src_file AS file, src AS subject, dst AS target, CASE label WHEN 'INHERITS' THEN 'extends' ELSE 'implements' END AS kind FROM edges WHERE label IN ('INHERITS', 'IMPLEMENTS')",
    "k4_updated": f"WITH {_VERSIONS} SELECT coalesce(repo_key, '') AS repo_key, coalesce(file_path, '') AS file_path, coalesce(symbol_name, '') AS symbol_name, coalesce(max(vec_id) FILTER (rn > 1), max(vec_id) FILTER (rn = 1)) AS vec_id FROM v GROUP BY ALL",
    "u5_without_orphans": "SELECT DISTINCT vec_id FROM code_embeddings e WHERE EXISTS (SELECT 1 FROM source_files s WHERE s.repo_key = e.repo_key AND s.file_path = e.file_path)",
    "a29_table_counts": "SELECT repo_key, count(*) AS rows, count(*) FILTER (NOT EXISTS (SELECT 1 FROM source_files s WHERE s.repo_key = e.repo_key AND s.file_path = e.file_path)) AS orphans FROM code_embeddings e GROUP BY repo_key",
    "k6_dot": f"WITH {_EDGES} SELECT graph, 'digraph {{' || chr(10) || string_agg('  \"' || src || '\" -> \"' || dst || '\";', chr(10) ORDER BY '  \"' || src || '\" -> \"' || dst || '\";') || chr(10) || '}}' AS text FROM e GROUP BY graph",
    "k6_mermaid": f"""WITH {_EDGES}, n AS (SELECT graph, name, row_number() OVER (PARTITION BY graph ORDER BY name) AS i FROM (SELECT graph, src AS name FROM e UNION SELECT graph, dst FROM e)),
      a AS (SELECT graph, string_agg('  n' || i || '["' || name || '"]', chr(10) ORDER BY i) AS t FROM n GROUP BY graph),
      b AS (SELECT e.graph, string_agg('  n' || x.i || ' --> n' || y.i, chr(10) ORDER BY src, dst) AS t FROM e JOIN n x ON x.graph = e.graph AND x.name = src JOIN n y ON y.graph = e.graph AND y.name = dst GROUP BY e.graph)
      SELECT graph, 'graph LR' || chr(10) || a.t || chr(10) || b.t AS text FROM a JOIN b USING (graph)""",
    "z7_tumbling": "SELECT event_type AS key, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS events FROM events GROUP BY ALL",
    "s21_sections": r"""WITH lines AS (
        SELECT doc_id, pos, line, regexp_matches(line, '^#{1,6} ') AS head FROM (
          SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (
            SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
      numbered AS (SELECT *, sum((head AND pos > 1)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM lines),
      parts AS (SELECT doc_id, section::INT AS section, string_agg(line, chr(10) ORDER BY pos) || chr(10) AS part, max(CASE WHEN head THEN nullif(regexp_extract(line, '^#{1,6} (.*)$', 1), '') END) AS title, bool_or(true) AS x, max(pos) AS last_pos, min(pos) AS first_pos
                FROM numbered GROUP BY ALL)
      SELECT doc_id, section, title FROM parts p WHERE trim(CASE WHEN last_pos = (SELECT max(last_pos) FROM parts q WHERE q.doc_id = p.doc_id) THEN left(part, length(part) - 1) ELSE part END, ' ') <> ''""",
    "k3_upsert": """SELECT repo_key, file_path, symbol_name, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_key, file_path, symbol_name ORDER BY updated_at DESC, vec_id DESC) AS rn FROM code_embeddings) WHERE rn = 1""",
    "s7_imports": "WITH " + FILES_SQL + r""", l AS (SELECT repo, path AS file, unnest(string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS text FROM files WHERE content IS NOT NULL),
      t AS (SELECT repo, file, regexp_extract(text, '^\s*(?:import\s+(?:\w+\s+)?"([^"]+)"|import\s+.*from\s+["'']([^"'']+)["'']|(?:import|from)\s+([\w.]+)|use\s+([\w:]+))', 0) AS m FROM l)
      SELECT DISTINCT repo, file, regexp_replace(regexp_replace(m, '^\s*(?:import\s+.*from\s+|import\s+(?:\w+\s+)?|from\s+|use\s+)', ''), '["'']', '', 'g') AS target FROM t WHERE m <> ''""",
}
