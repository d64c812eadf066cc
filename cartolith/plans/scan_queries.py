"""Queries of scanners and predicates whose raw texts are written from the tables, so that what is read back is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions import complexity, predicates
from cartolith.operators import duplicates, quality, retrieval
from cartolith.plans.quality_queries import _GREP, _SPANS, _spans
from cartolith.plans.structure_queries import _CODE_ROUTES, x24_code_routes
from cartolith.session import table
from cartolith.sources import scanners
from cartolith.sources.tables import COMMITS_SQL, ENTRIES_SQL, FILES_SQL, GRAPH_SQL, commits, entries, files, package_sql, snapshot_graphs

WORDS = ["token", "shard"]
PATTERNS = ["*_test.go", "vendor/", "!vendor/keep.go", "/src/gen*", "internal/**/x.go"]
STANDARD = ["fmt", "os", "errors", "time"]


def s8_numstat(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a log as the scanner of histories reads them."""
    rows = commits(spark, folder)
    log = rows.select("commit_id", F.concat_ws("\t", F.col("additions").cast("string"), F.col("deletions").cast("string"), F.concat(F.lit("{a => b}/"), "path")).alias("line"))
    return scanners.numstat_rows(log)


def s10_renames(spark: SparkSession, folder: str) -> DataFrame:
    log = commits(spark, folder).select("commit_id", F.concat(F.lit("1\t2\tsrc/{a => b}/"), "path").alias("line"))
    return scanners.renames(log).distinct()


def s9_commit_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of each commit, names only."""
    return commits(spark, folder).select("commit_id", "path").distinct()


def s11_hunks(spark: SparkSession, folder: str) -> DataFrame:
    """One diff a brand, a hunk a part; sizes divisible by seven are taken away altogether."""
    part = table(spark, folder, "part")
    length = F.when(F.col("p_size") % 7 == 0, 0).otherwise(F.col("p_size"))
    hunk = F.concat(F.lit("--- a/f"), "p_partkey", F.lit("\n+++ b/f"), "p_partkey", F.lit("\n@@ -1,2 +"), F.col("p_partkey") * 10, F.lit(","), length, F.lit(" @@\n+x\n"))
    return scanners.diff_hunks(part.groupBy(F.col("p_brand").alias("diff_id")).agg(F.array_join(F.collect_list(hunk), "").alias("text")))


def s12_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest a brand, a dependency a part."""
    part = table(spark, folder, "part")
    line = F.concat(F.lit("\tx.org/p"), "p_partkey", F.lit(" v1."), "p_size", F.lit(".0"))
    text = F.concat(F.lit("module m\n\ngo 1.22\n\nrequire (\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n)\n"))
    return scanners.manifest_dependencies(part.groupBy(F.col("p_brand").alias("repo")).agg(text.alias("content")).withColumn("path", F.lit("sub/go.mod")))


def s13_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of a metrics store, an event a point."""
    point = F.concat(F.lit("["), F.unix_timestamp("ts"), F.lit(',"'), F.col("event_id"), F.lit('"]'))
    events = table(spark, folder, "events").groupBy("event_type", "user_id").agg(F.array_join(F.collect_list(point), ",").alias("p"))
    json = F.concat(F.lit('{"data":{"result":[{"metric":{"__name__":"'), "event_type", F.lit('","user":"'), "user_id", F.lit('"},"values":['), "p", F.lit("]}]}}"))
    found = scanners.metric_samples(events.select(json.alias("json")))
    return found.select("metric", F.col("labels")["user"].alias("user"), F.unix_timestamp("ts").alias("seconds"), "value")


def s14_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Traces, a user's events the spans of one."""
    span = F.concat(
        F.lit('{"traceID":"t'), "user_id", F.lit('","spanID":"s'), "event_id", F.lit('","operationName":"'), "event_type", F.lit('","startTime":'), F.unix_timestamp("ts"),
        F.lit(',"duration":'), F.col("event_id") % 100, F.lit(',"tags":[{"key":"k","value":"v'), F.col("event_id") % 7, F.lit('"}]}'),
    )
    traces = table(spark, folder, "events").groupBy("user_id").agg(F.concat(F.lit('{"data":[{"spans":['), F.array_join(F.collect_list(span), ","), F.lit("]}]}")).alias("json"))
    return scanners.trace_spans(traces).select("trace_id", "span_id", "operation", "duration", F.col("tags")["k"].alias("k"))


def s15_pins(spark: SparkSession, folder: str) -> DataFrame:
    """A compose file a brand, an image a part."""
    part = table(spark, folder, "part")
    tag = F.when(F.col("p_size") % 5 > 0, F.concat(F.lit(":"), "p_size")).otherwise("")
    line = F.concat(F.lit("    image: reg/p"), "p_partkey", tag)
    text = F.concat(F.lit("services:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda x: x["l"]), "\n"))
    rows = part.groupBy(F.col("p_brand").alias("repo")).agg(text.alias("content")).withColumn("path", F.lit("compose.yaml"))
    return scanners.image_pins(rows).select("repo", "line", "image", "tag", "unresolved")


def s19_golden(spark: SparkSession, folder: str) -> DataFrame:
    """Golden records, one a customer, with comments and blank lines between."""
    lines = table(spark, folder, "customer").select(F.explode(F.array(
        F.lit("# comment"), F.lit(" "), F.concat(F.lit('{"repo":"r","query":"'), "c_name", F.lit('","language":"go","expected_top_3":["'), "c_mktsegment", F.lit('"]}'))
    )).alias("value"))
    return scanners.golden_records(lines).withColumn("expected", F.array_join("expected", ","))


def s2_gitignored(spark: SparkSession, folder: str) -> DataFrame:
    own = files(spark, folder).where("path IS NOT NULL")
    return own.select("repo", "path", scanners.gitignored(F.col("path"), PATTERNS).alias("ignored"))


def s3_focused(spark: SparkSession, folder: str) -> DataFrame:
    own = files(spark, folder)
    parts = [scanners.focused(own, f).select("repo", "path", F.lit(f).alias("focus")) for f in ("**/*_test.go", "internal", "token shard", "src/")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def s4_content_focused(spark: SparkSession, folder: str) -> DataFrame:
    return scanners.content_focused(files(spark, folder), WORDS).select("repo", "path")


def f_name_predicates(spark: SparkSession, folder: str) -> DataFrame:
    """Patterns of names, words in them, and entry points, of every entry."""
    name = F.col("name")
    return entries(spark, folder).where("name IS NOT NULL").select(
        "entry_id", predicates.matches_name(name, "merge*er*").alias("f9"), predicates.contains_any(name, ["SHARD", "token"]).alias("f8"), predicates.is_entry_point(name).alias("f23"),
    )


def f_route_predicates(spark: SparkSession, folder: str) -> DataFrame:
    found = x24_code_routes(spark, folder).select("path").distinct()
    return found.select("path", predicates.is_generic_route(F.col("path")).alias("f22"))


def f20_import_category(spark: SparkSession, folder: str) -> DataFrame:
    found = scanners.import_rows(files(spark, folder)).select("target").distinct()
    return found.select("target", predicates.import_category(F.col("target"), F.lit("hugobeba"), STANDARD).alias("category"))


def f24_fix_messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", predicates.is_fix(F.col("text")).alias("fix"))


def f11_grep_context(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.grep_lines(files(spark, folder), r"(?i)error|fault", 1).select("repo", "path", "line", "around")


def j11_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols that hunks touch: every tenth line begins a hunk of four."""
    spans = _spans(spark, folder).where("start_line IS NOT NULL AND end_line IS NOT NULL AND file IS NOT NULL")
    hunks = spans.select("repo", "file", F.concat_ws("#", "name", "start_line").alias("b_id"), (F.col("start_line") + 10).alias("b_start"), (F.col("start_line") + 14).alias("b_end")).where("b_start % 3 = 0")
    a = spans.select("repo", "file", F.concat_ws("#", "name", "start_line").alias("a_id"), F.col("start_line").alias("a_start"), F.col("end_line").alias("a_end"))
    return retrieval.overlapping_spans(a.distinct(), hunks.distinct())


def j19_symbol_diff(spark: SparkSession, folder: str) -> DataFrame:
    own = entries(spark, folder).where("name IS NOT NULL AND kind IS NOT NULL")
    return quality.symbol_diff(own.where("is_public"), own.where("NOT is_public"))


def j24_siblings(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.sibling_pairs(entries(spark, folder))


def x12_architecture(spark: SparkSession, folder: str) -> DataFrame:
    """Packages and the share of calls that cross them, from the calls alone."""
    g = snapshot_graphs(spark, folder)
    return quality.call_ratios(g.calls()).select("graph", "calls", "cross_package")


def x20_without_comments(spark: SparkSession, folder: str) -> DataFrame:
    own = entries(spark, folder).where("body IS NOT NULL")
    return own.select("entry_id", F.md5(complexity.without_comments(F.col("body"), F.lower(F.coalesce("language", F.lit(""))))).alias("code"))


def x23_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Layers by the folders that hold a Rust file named main or a module file, and their role."""
    own = files(spark, folder).where("repo IS NOT NULL AND path IS NOT NULL").dropDuplicates(["repo", "path"])
    return scanners.detected_layers(own.where(F.col("path").rlike(r"(?:^|/)[a-m][^/]*\.rs$")), own)


QUERIES = {
    f.__name__: f
    for f in (
        s8_numstat, s10_renames, s9_commit_files, s11_hunks, s12_dependencies, s13_samples, s14_spans, s15_pins, s19_golden, s2_gitignored, s3_focused, s4_content_focused,
        f_name_predicates, f_route_predicates, f20_import_category, f24_fix_messages, f11_grep_context, j11_overlaps, j19_symbol_diff, j24_siblings, x12_architecture,
        x20_without_comments, x23_layers,
    )
}

_E, _F, _C = "WITH " + ENTRIES_SQL, "WITH " + FILES_SQL, "WITH " + COMMITS_SQL
_STRINGS = complexity.QUOTED.replace("*+", "*").replace("'", "''")
_TARGETS = r"""found AS (SELECT DISTINCT regexp_replace(regexp_replace(m, '^\s*(?:import\s+.*from\s+|import\s+(?:\w+\s+)?|from\s+|use\s+)', ''), '["'']', '', 'g') AS target FROM (
    SELECT regexp_extract(text, '^\s*(?:import\s+(?:\w+\s+)?"([^"]+)"|import\s+.*from\s+["'']([^"'']+)["'']|(?:import|from)\s+([\w.]+)|use\s+([\w:]+))', 0) AS m FROM (
      SELECT unnest(string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS text FROM files WHERE content IS NOT NULL)) WHERE m <> '')"""
_ROLE = "CASE " + " ".join(
    f"WHEN {' OR '.join(f"contains(coalesce(content, ''), '{sign}')" for sign in signs)} THEN {k}" for k, (_, signs) in enumerate(scanners.ROLES, 1)
) + " ELSE 4 END"
SQL = {
    "s8_numstat": _C + "SELECT commit_id, 'b/' || path AS path, additions, deletions FROM commits",
    "s10_renames": _C + "SELECT DISTINCT 'src/a/' || path AS old_path, 'src/b/' || path AS new_path FROM commits",
    "s9_commit_files": _C + "SELECT DISTINCT commit_id, path FROM commits",
    "s11_hunks": "SELECT p_brand AS diff_id, 'f' || p_partkey AS file, (p_partkey * 10)::INT AS start_line, (p_partkey * 10 + p_size - 1)::INT AS end_line FROM part WHERE p_size % 7 > 0",
    "s12_dependencies": "SELECT DISTINCT p_brand AS repo, 'sub/go.mod' AS path, 'go' AS ecosystem, 'x.org/p' || p_partkey AS name, 'v1.' || p_size || '.0' AS version FROM part",
    "s13_samples": "SELECT event_type AS metric, user_id::VARCHAR AS user, epoch(ts)::BIGINT AS seconds, event_id::DOUBLE AS value FROM (SELECT event_type, user_id, date_trunc('second', ts) AS ts, event_id FROM events)",
    "s14_spans": "SELECT 't' || user_id AS trace_id, 's' || event_id AS span_id, event_type AS operation, event_id % 100 AS duration, 'v' || (event_id % 7) AS k FROM events",
    "s15_pins": "SELECT p_brand AS repo, (1 + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::INT AS line, 'reg/p' || p_partkey AS image, CASE WHEN p_size % 5 > 0 THEN p_size::VARCHAR END AS tag, false AS unresolved FROM part",
    "s19_golden": "SELECT 'r' AS repo, c_name AS query, 'go' AS language, c_mktsegment AS expected FROM customer",
    "s2_gitignored": _F + r" SELECT repo, path, CASE WHEN regexp_matches(path, '^internal/(?:.*/)?x\.go(?:/|$)') THEN true WHEN regexp_matches(path, '^src/gen[^/]*(?:/|$)') THEN true WHEN regexp_matches(path, '^vendor/keep\.go(?:/|$)') THEN false WHEN regexp_matches(path, '(^|/)vendor/') THEN true ELSE regexp_matches(path, '(^|/)[^/]*_test\.go(?:/|$)') END AS ignored FROM files WHERE path IS NOT NULL",
    "s3_focused": _F + r""" SELECT repo, path, '**/*_test.go' AS focus FROM files WHERE regexp_matches(path, '^(?:.*/)?[^/]*_test\.go$') UNION ALL SELECT repo, path, 'internal' FROM files WHERE contains(lower(path), 'internal')
      UNION ALL SELECT repo, path, 'token shard' FROM files WHERE contains(lower(path), 'token') OR contains(lower(path), 'shard') UNION ALL SELECT repo, path, 'src/' FROM files WHERE starts_with(path, 'src/')""",
    "s4_content_focused": _F + r" SELECT repo, path FROM files WHERE len(list_filter(regexp_extract_all(lower(coalesce(content, '')), '[a-z_]\w*'), lambda t: contains(t, 'token') OR contains(t, 'shard'))) > 0",
    "f_name_predicates": f"{_E} SELECT entry_id, regexp_matches(name, '(?i)^merge.*er.*$') AS f9, contains(lower(name), 'shard') OR contains(lower(name), 'token') AS f8, regexp_matches(name, '{predicates.ENTRY_POINT}') AS f23 FROM entries WHERE name IS NOT NULL",
    "f_route_predicates": f"WITH {_CODE_ROUTES} SELECT DISTINCT path, regexp_matches(path, '{predicates.HEALTH_ROUTE}') OR len(list_filter(string_split(path, '/'), lambda s: s <> '' AND s <> '*')) < 2 AS f22 FROM kept",
    "f20_import_category": f"{_F}, {_TARGETS} SELECT target, CASE WHEN split_part(target, '/', 1) IN ('fmt', 'os', 'errors', 'time') THEN 'stdlib' WHEN starts_with(target, 'hugobeba') OR starts_with(target, '.') OR starts_with(target, 'crate::') THEN 'internal' ELSE 'external' END AS category FROM found",
    "f24_fix_messages": r"SELECT doc_id, regexp_matches(text, '(?i)\b(?:fix|fixes|fixed|hotfix|bug|bugfix|revert|regress|regression)\b') AS fix FROM documents WHERE text IS NOT NULL",
    "f11_grep_context": f"{_F}, {_GREP}, al AS (SELECT repo, path, unnest(l) AS text, generate_subscripts(l, 1)::INT AS line FROM (SELECT repo, path, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM files WHERE content IS NOT NULL))"
    " SELECT h.repo, h.path, h.line, string_agg(a.text, chr(10) ORDER BY a.line) AS around FROM hits h JOIN al a ON a.repo IS NOT DISTINCT FROM h.repo AND a.path = h.path AND a.line BETWEEN h.line - 1 AND h.line + 1 GROUP BY ALL",
    "j11_overlaps": f"{_E}, {_SPANS}, s AS (SELECT DISTINCT repo, file, concat_ws('#', name, start_line) AS id, start_line, end_line FROM spans WHERE start_line IS NOT NULL AND end_line IS NOT NULL AND file IS NOT NULL),"
    " h AS (SELECT DISTINCT repo, file, id, start_line + 10 AS b, start_line + 14 AS e FROM s WHERE (start_line + 10) % 3 = 0) SELECT s.repo, s.file, s.id AS a_id, h.id AS b_id FROM s JOIN h ON h.repo = s.repo AND h.file = s.file AND start_line <= e AND b <= end_line",
    "j19_symbol_diff": f"{_E}, o AS (SELECT name, kind, bool_or(is_public) AS p, bool_or(NOT is_public) AS q FROM entries WHERE name IS NOT NULL AND kind IS NOT NULL AND is_public IS NOT NULL GROUP BY ALL) SELECT name, kind, CASE WHEN p AND q THEN 'both' WHEN p THEN 'only_a' ELSE 'only_b' END AS side FROM o",
    "j24_siblings": rf"{_E} SELECT repo_key, name, regexp_replace(regexp_extract(signature, '\w+\s*(\([^)]*\))[^(]*$', 1), '\s+', ' ', 'g') AS params, count(DISTINCT receiver) AS receivers FROM entries WHERE kind = 'method' AND receiver IS NOT NULL GROUP BY ALL HAVING count(DISTINCT receiver) > 1",
    "x12_architecture": "WITH " + GRAPH_SQL + f" SELECT graph, count(*) AS calls, round(avg(({package_sql('src_file')} <> {package_sql('dst_file')})::INT), 6) AS cross_package FROM calls GROUP BY graph",
    "x20_without_comments": f"{_E} SELECT entry_id, md5(CASE WHEN lower(coalesce(language, '')) IN ('python', 'ruby') THEN regexp_replace(body, '({_STRINGS})|{complexity.HASH_COMMENTS}', '\\1', 'g') ELSE regexp_replace(body, '({_STRINGS})|{complexity.C_COMMENTS}', '\\1', 'g') END) AS code FROM entries WHERE body IS NOT NULL",
    "x23_layers": rf"""{_F}, f AS MATERIALIZED (SELECT DISTINCT ON (repo, path) repo, path, content FROM files WHERE repo IS NOT NULL AND path IS NOT NULL), r AS (SELECT DISTINCT repo, {package_sql('path')} AS layer FROM f WHERE regexp_matches(path, '(?:^|/)[a-m][^/]*\.rs$')),
      o AS MATERIALIZED (SELECT repo, path, content, layer FROM (SELECT f.*, r.layer, row_number() OVER (PARTITION BY f.repo, path ORDER BY CASE WHEN r.layer = '.' THEN 0 ELSE length(r.layer) END DESC, r.layer DESC) AS rn
        FROM f JOIN r ON r.repo = f.repo AND (r.layer = '.' OR starts_with({package_sql('path')} || '/', r.layer || '/'))) WHERE rn = 1),
      g AS (SELECT repo, layer, min({_ROLE}) AS k FROM o GROUP BY ALL) SELECT o.repo, path, o.layer, ['server', 'client', 'worker', 'library'][k] AS role FROM o JOIN g USING (repo, layer)""",
}
