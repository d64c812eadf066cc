"""Queries over symbols and files: metrics, grades, duplicates, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions import predicates, text
from cartolith.operators import duplicates, quality, retrieval
from cartolith.operators import graph_templates as gt
from cartolith.plans.measure_sql import measured_sql
from cartolith.sources import scanners
from cartolith.sources.tables import (
    ENTRIES_SQL,
    FILES_SQL,
    GRAPH_SQL,
    entries,
    files,
    package_of,
    package_sql,
    snapshot_graphs,
)


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    own, src = entries(spark, folder), files(spark, folder)
    ratios = quality.repository_ratios(src).withColumnRenamed("repo", "repo_key").na.drop(subset=["repo_key"])
    needed = scanners.manifest_dependencies(src).groupBy(F.col("repo").alias("repo_key")).agg(F.count("*").alias("total_deps"))
    return (
        quality.function_metrics(own)
        .join(ratios, "repo_key", "left")
        .join(duplicates.duplication_ratio(own).select("repo_key", F.col("ratio").alias("duplication")), "repo_key", "left")
        .join(needed, "repo_key", "left")
        .withColumn("deps_scanned", F.lit(True))
    )


def call_sites(spark: SparkSession, folder: str) -> DataFrame:
    """``repo, caller_file, callee``: names that bodies of entries call, comments left in."""
    own = entries(spark, folder).where(F.col("body").isNotNull())
    return own.select(
        F.col("repo_key").alias("repo"), F.col("file").alias("caller_file"),
        F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b([A-Za-z_]\w*)\("), F.lit(1)))).alias("callee"),
    ).distinct()


def _symbols(spark: SparkSession, folder: str) -> DataFrame:
    return entries(spark, folder).select(F.col("repo_key").alias("repo"), "name", "file")


def a20_fans(spark: SparkSession, folder: str) -> DataFrame:
    used = gt.imports(snapshot_graphs(spark, folder))
    return quality.fans(used.select("graph", package_of(F.col("file")).alias("src"), F.col("package").alias("dst")))


def g11_unused(spark: SparkSession, folder: str) -> DataFrame:
    g = snapshot_graphs(spark, folder)
    called = g.edges.where(F.col("label").isin("CALLS", "USES")).select("graph", F.col("dst").alias("name"), F.col("dst_file").alias("file"))
    bound = g.edges.where(F.col("label") == "IMPLEMENTS").select("graph", F.col("src").alias("name"), F.col("src_file").alias("file"))
    return quality.unused_functions(g.symbols.withColumn("language", predicates.language_of(F.col("file"))), called, bound)


def g12_dead_code_prior(spark: SparkSession, folder: str) -> DataFrame:
    g = snapshot_graphs(spark, folder)
    return quality.dead_code_prior(g.symbols, g.calls().select("graph", F.col("dst").alias("name"), F.col("dst_file").alias("file")))


def largest_repositories(spark: SparkSession, folder: str) -> list[str]:
    """The two repositories with most entries; ties by name."""
    own = entries(spark, folder).where("repo_key IS NOT NULL").groupBy("repo_key").agg(F.count("*").alias("n"))
    return [r["repo_key"] for r in own.orderBy(F.desc("n"), "repo_key").limit(2).collect()]


def j21_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of the two largest repositories matched one to one."""
    own = entries(spark, folder).withColumn("id", F.col("entry_id"))
    a, b = (own.where(F.col("repo_key") == r) for r in largest_repositories(spark, folder))
    return quality.greedy_matches(a, b)


def x9_match_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return quality.match_breakdown(j21_matches(spark, folder))


def j21_similar_names(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of structs of different repositories, the largest and the second, whose names are similar."""
    own = entries(spark, folder).where("kind = 'struct'").select(F.col("entry_id").alias("id"), "repo_key", "kind", F.col("name").alias("text"))
    a, b = (own.where(F.col("repo_key") == r) for r in largest_repositories(spark, folder))
    return quality.edit_candidates(a, b, quality.LEAST_NAME)


def f_path_predicates(spark: SparkSession, folder: str) -> DataFrame:
    """Every predicate on every file."""
    path = F.col("path")
    return files(spark, folder).select(
        "repo", "path",
        predicates.is_ignored(path).alias("ignored"), predicates.is_test_file(path).alias("test"),
        predicates.is_low_priority(path).alias("low"), predicates.is_artifact(path).alias("artifact"),
        predicates.caller_kind(path).alias("caller"), predicates.language_of(path).alias("language"),
        predicates.matches_glob(path, "**/*_test.go").alias("globbed"),
    )


def f16_exported(spark: SparkSession, folder: str) -> DataFrame:
    own = entries(spark, folder)
    return own.select("entry_id", predicates.is_exported(F.col("name"), F.col("language")).alias("exported"))


def f10_grep(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.grep_lines(files(spark, folder), r"(?i)error|fault").select("repo", "path", "line", "text")


def t5_match_density(spark: SparkSession, folder: str) -> DataFrame:
    hits = f10_grep(spark, folder).select(F.concat_ws("/", "repo", "path").alias("file"), "line")
    return retrieval.match_density(hits)


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    return f10_grep(spark, folder).select(
        F.concat_ws("#", "repo", "path", "line").alias("point_id"), "repo", F.col("path").alias("file"), "line"
    )


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return entries(spark, folder).select(
        F.col("repo_key").alias("repo"), F.regexp_replace("file", r"\\", "/").alias("file"), "name", "start_line", "end_line"
    ).distinct()


def j10_innermost(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.innermost_spans(_hits(spark, folder), _spans(spark, folder))


def j12_preceding(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.preceding_symbols(_hits(spark, folder), _spans(spark, folder))


def r3_identifier_parts(spark: SparkSession, folder: str) -> DataFrame:
    return entries(spark, folder).select("entry_id", F.array_join(text.split_identifier(F.col("name")), " ").alias("parts"))


QUERIES = {
    "a14_function_metrics": lambda s, d: quality.function_metrics(entries(s, d)),
    "a15_repository_ratios": lambda s, d: quality.repository_ratios(files(s, d)),
    "a16_duplication": lambda s, d: duplicates.duplication_ratio(entries(s, d)),
    "a17_grade": lambda s, d: quality.grade(_metrics(s, d)).select("repo_key", "score", "grade"),
    "a18_recommendations": lambda s, d: quality.recommendations(_metrics(s, d)),
    "a14_magic_numbers": lambda s, d: quality.magic_numbers(entries(s, d)),
    "scalar_measures": lambda s, d: quality.function_measures(entries(s, d)).drop("start_line"),
    "j21_matches": j21_matches,
    "j21_similar_names": j21_similar_names,
    "x9_match_breakdown": x9_match_breakdown,
    "a18_outliers": lambda s, d: quality.outliers(entries(s, d)),
    "a19_file_complexity": lambda s, d: quality.file_complexity(entries(s, d)),
    "a8_call_ratios": lambda s, d: quality.call_ratios(snapshot_graphs(s, d).calls()),
    "a20_fans": a20_fans,
    "a21_languages": lambda s, d: quality.language_shares(files(s, d)),
    "a22_relations": lambda s, d: quality.relation_counts(snapshot_graphs(s, d).edges),
    "g11_unused": g11_unused,
    "g12_dead_code_prior": g12_dead_code_prior,
    "j13_resolve_callees": lambda s, d: quality.resolve_callees(call_sites(s, d), _symbols(s, d)),
    "j27_reference_graph": lambda s, d: quality.reference_graph(call_sites(s, d), _symbols(s, d)),
    "j15_exact_duplicates": lambda s, d: duplicates.exact_members(entries(s, d)),
    "j15_exact_groups": lambda s, d: duplicates.exact_groups(entries(s, d)),
    "f_path_predicates": f_path_predicates,
    "f16_exported": f16_exported,
    "f10_grep": f10_grep,
    "t5_match_density": t5_match_density,
    "j10_innermost": j10_innermost,
    "j12_preceding": j12_preceding,
    "r3_identifier_parts": r3_identifier_parts,
}

_E = "WITH " + ENTRIES_SQL
_F = "WITH " + FILES_SQL
_G = "WITH " + GRAPH_SQL
_TEST = predicates.TEST_FILE.replace("'", "''")
_PUBLIC = "coalesce(is_public, false) OR CASE WHEN lower(coalesce(language, '')) IN ('go', 'java', 'csharp') THEN regexp_matches(name, '^[A-Z]') ELSE NOT starts_with(name, '_') AND name <> '' END"
_FM = measured_sql(_TEST) + f""",
fm AS (SELECT m.*, doc_ratio, interfaces FROM (
    SELECT repo_key, count(*) AS functions, """ + ", ".join(
    f"round(coalesce(avg({c}), 0), 6) AS avg_{name}, coalesce(max({c}), 0)::BIGINT AS max_{name}"
    for c, name in (("lines", "lines"), ("cyclomatic", "complexity"), ("cognitive", "cognitive"), ("nesting", "nesting"), ("parameters", "parameters"))
) + f""", round(coalesce(avg(handled), 0), 6) AS error_ratio, round(coalesce(avg((magic > 0)::INT), 0), 6) AS magic_ratio FROM measured GROUP BY repo_key) m
  JOIN (SELECT repo_key, round(coalesce(avg(CASE WHEN {_PUBLIC} THEN coalesce((length(doc_comment) > 0)::INT, 0) END), 0), 6) AS doc_ratio,
          count(*) FILTER (kind = 'interface') AS interfaces FROM entries GROUP BY repo_key) d USING (repo_key))"""
_RR = f"""rr AS (SELECT repo, count(*) AS files, round(avg(CASE WHEN regexp_matches(path, '{_TEST}') THEN 1 ELSE 0 END), 6) AS test_ratio,
  round(avg(CASE WHEN coalesce(lines, 0) > 250 THEN 1 ELSE 0 END), 6) AS large_ratio FROM files GROUP BY repo)"""
_DR = """dr AS (SELECT repo_key, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS ratio, sum(n)::BIGINT AS functions
  FROM (SELECT repo_key, body_hash, count(*) AS n FROM entries WHERE body_hash <> 0 AND kind IN ('function', 'method') GROUP BY ALL) GROUP BY repo_key)"""


def _sub_score(area: str, measure: str, best: float, worst: float) -> str:
    known = {"semantic_ratio": "0.0", "fresh_ratio": "0.0", "secure_ratio": "0.0"}
    score = f"least(greatest((coalesce({known.get(measure, measure)}::DOUBLE, 0) - {worst}) / ({best} - {worst}), 0), 1)"
    return "1.0" if area in quality.OF_DEPENDENCIES else score  # the tables hold no manifests


_PART = [_sub_score(area, measure, best, worst) for area, measure, best, worst, _ in quality.GRADE]
_ALL = f"{_E}, {FILES_SQL}, {_FM}, {_RR}, {_DR}, m AS (SELECT fm.*, rr.files, rr.test_ratio, rr.large_ratio, dr.ratio AS duplication FROM fm LEFT JOIN rr ON rr.repo = fm.repo_key LEFT JOIN dr USING (repo_key))"
_GREP = "hits AS MATERIALIZED (SELECT repo, path, pos AS line, text FROM (SELECT repo, path, unnest(lines_) AS text, generate_subscripts(lines_, 1)::INT AS pos FROM (SELECT repo, path, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines_ FROM files WHERE content IS NOT NULL)) WHERE regexp_matches(text, '(?i)error|fault'))"
_SPANS = r"spans AS MATERIALIZED (SELECT DISTINCT repo_key AS repo, replace(file, '\', '/') AS file, name, start_line, end_line FROM entries)"
_CALLS = r"call_sites AS MATERIALIZED (SELECT DISTINCT repo_key AS repo, file AS caller_file, unnest(regexp_extract_all(body, '\b([A-Za-z_]\w*)\(', 1)) AS callee FROM entries WHERE body IS NOT NULL), homes AS MATERIALIZED (SELECT DISTINCT repo_key AS repo, name AS callee, file FROM entries)"
_CAMEL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'),"
    r" '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')"
)
_LANGUAGES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in predicates.EXTENSIONS.items())
SQL = {
    "a14_function_metrics": f"{_E}, {_FM} SELECT * FROM fm",
    "a15_repository_ratios": f"{_F}, {_RR} SELECT * FROM rr",
    "a16_duplication": f"{_E}, {_DR} SELECT repo_key, ratio, functions FROM dr",
    "a17_grade": f"{_ALL}, s AS (SELECT repo_key, CASE WHEN coalesce(files, 1) = 0 THEN 0 ELSE round(round(100 * (" + " + ".join(f"{x[-1]} * {p}" for p, x in zip(_PART, quality.GRADE, strict=True)) + "), 9)) END AS score FROM m)"
    " SELECT repo_key, score, CASE WHEN score >= 90 THEN 'A+' WHEN score >= 80 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END AS grade FROM s",
    "a18_recommendations": f"{_ALL} SELECT repo_key, area, points, round(points)::INT AS potential FROM (" + " UNION ALL ".join(
        f"SELECT repo_key, '{x[0]}' AS area, 1 - {p} AS gap, round(100 * {x[-1]} * (1 - {p}), 4) AS points FROM m" for p, x in zip(_PART, quality.GRADE, strict=True)
    ) + ") WHERE round(gap, 9) >= 0.05",
    "a14_magic_numbers": f"{_E}, {measured_sql(_TEST)} SELECT repo_key, file, name, start_line, magic FROM measured WHERE magic > 0",
    "scalar_measures": f"{_E}, {measured_sql(_TEST)} SELECT repo_key, file, name, lines, cyclomatic, cognitive, nesting, magic, parameters, handled FROM measured",
    "j21_similar_names": f"""{_E}, r AS (SELECT repo_key, row_number() OVER (ORDER BY count(*) DESC, repo_key) AS rn FROM entries WHERE repo_key IS NOT NULL GROUP BY repo_key),
      s AS (SELECT entry_id, name, rn FROM entries JOIN r USING (repo_key) WHERE kind = 'struct' AND name <> '')
      SELECT a.entry_id AS a_id, b.entry_id AS b_id, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) AS score
      FROM s a JOIN s b ON a.rn = 1 AND b.rn = 2 WHERE round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) >= 0.7""",
    "a18_outliers": f"""{_E} SELECT a.repo_key, a.name AS most_complex, b.name AS longest FROM
      (SELECT repo_key, name, row_number() OVER (PARTITION BY repo_key ORDER BY coalesce(complexity, 0) DESC, file, name) AS rn FROM entries WHERE kind IN ('function', 'method')) a
      JOIN (SELECT repo_key, name, row_number() OVER (PARTITION BY repo_key ORDER BY coalesce(end_line - start_line + 1, 0) DESC, file, name) AS rn FROM entries WHERE kind IN ('function', 'method')) b
      ON a.repo_key = b.repo_key AND a.rn = 1 AND b.rn = 1""",
    "a19_file_complexity": f"{_E} SELECT repo_key, file, round(avg(complexity), 6) AS complexity FROM entries WHERE kind IN ('function', 'method') GROUP BY ALL",
    "a8_call_ratios": _G + f"SELECT graph, count(*) AS calls, round(avg((src_file <> dst_file)::INT), 6) AS cross_file, round(avg(({package_sql('src_file')} <> {package_sql('dst_file')})::INT), 6) AS cross_package FROM calls GROUP BY graph",
    "a20_fans": _G + f""", e AS (SELECT DISTINCT graph, {package_sql('src_file')} AS src, {package_sql('dst_file')} AS dst FROM edges WHERE {package_sql('src_file')} <> {package_sql('dst_file')})
      SELECT graph, package, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT graph, src AS package, 0 AS i, 1 AS o FROM e UNION ALL SELECT graph, dst, 1, 0 FROM e) GROUP BY ALL""",
    "a21_languages": _F + """ SELECT repo, language, files, round(files / sum(files) OVER (PARTITION BY repo), 6) AS share,
      row_number() OVER (PARTITION BY repo ORDER BY files DESC, language) = 1 AS dominant FROM (SELECT repo, language, count(*) AS files FROM files WHERE language IS NOT NULL GROUP BY ALL)""",
    "a22_relations": _G + "SELECT label, count(*) AS edges, count(DISTINCT (graph, src, src_file)) AS subjects FROM edges GROUP BY label",
    "g11_unused": _G + f"""SELECT graph, name, file, kind,
        CASE WHEN NOT CASE language WHEN 'go' THEN regexp_matches(name, '^[A-Z]') WHEN 'python' THEN NOT starts_with(name, '_') ELSE NOT regexp_matches(name, '^[_#]') END THEN 'high'
             WHEN kind = 'function' THEN 'medium' ELSE 'low' END AS confidence
      FROM (SELECT *, CASE lower(regexp_extract(file, '[.](\\w+)$', 1)) {_LANGUAGES} END AS language FROM symbols) s
      WHERE kind IN ('function', 'method') AND NOT regexp_matches(name, '{predicates.ENTRY_POINT}') AND NOT regexp_matches(file, '{_TEST}')
        AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.label IN ('CALLS', 'USES') AND e.graph = s.graph AND e.dst = s.name AND e.dst_file = s.file)
        AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.label = 'IMPLEMENTS' AND e.graph = s.graph AND e.src = s.name AND e.src_file = s.file)""",
    "g12_dead_code_prior": _G + """SELECT graph, name, file, prior FROM (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY prior DESC, name, file) AS place FROM (
        SELECT s.graph, name, file, n, round(CASE WHEN name = 'main' THEN 0.05 WHEN starts_with(name, 'Test') OR starts_with(name, 'test_') THEN 0.1
            WHEN starts_with(name, 'setup_') OR starts_with(name, 'teardown_') OR starts_with(name, 'example_') OR starts_with(name, 'Example') OR starts_with(name, 'Benchmark') THEN 0.2 ELSE 1 END
          * CASE WHEN contains(file, '_test.go') OR contains(file, '_test.py') THEN 0.1 WHEN contains(file, '/test/') OR contains(file, '/tests/') THEN 0.15
            WHEN contains(file, 'evaluation/') OR contains(file, 'examples/') THEN 0.25 WHEN contains(file, '/scripts/') THEN 0.3 WHEN contains(file, 'benchmark') THEN 0.2 ELSE 1 END
          * complexity, 6) AS prior
        FROM symbols s JOIN (SELECT graph, count(*) AS n FROM symbols GROUP BY graph) USING (graph) WHERE kind = 'function'
          AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.graph = s.graph AND c.dst = s.name AND c.dst_file = s.file)))
      WHERE place <= least(200, greatest(50, floor(n / 60)))""",
    "j13_resolve_callees": f"""{_E}, {_CALLS}, c AS (SELECT s.repo, caller_file, s.callee, h.file AS callee_file,
        CASE WHEN caller_file = h.file THEN 0 WHEN {package_sql('caller_file')} = {package_sql('h.file')} THEN 1 ELSE 2 END AS rank,
        len(list_filter(range(1, least(len(string_split(caller_file, '/')), len(string_split(h.file, '/'))) + 1),
          lambda i: string_split(caller_file, '/')[1:i] = string_split(h.file, '/')[1:i])) AS shared
      FROM call_sites s JOIN homes h USING (repo, callee))
      SELECT repo, caller_file, callee, callee_file FROM (SELECT *, row_number() OVER (PARTITION BY repo, caller_file, callee ORDER BY rank, shared DESC, callee_file) AS rn FROM c) WHERE rn = 1""",
    "j27_reference_graph": f"""{_E}, {_CALLS}, n AS (SELECT repo, callee, count(*) AS n FROM homes GROUP BY ALL)
      SELECT s.repo, caller_file AS src, h.file AS dst, round(sum(1 / n), 6) AS weight FROM call_sites s JOIN homes h USING (repo, callee) JOIN n USING (repo, callee) WHERE caller_file <> h.file GROUP BY ALL""",
    "j15_exact_duplicates": f"{_E} SELECT * FROM (SELECT min(entry_id) OVER (PARTITION BY body_hash) AS first_id, entry_id FROM entries WHERE body_hash <> 0) WHERE first_id <> entry_id",
    "j15_exact_groups": f"{_E} SELECT body_hash, count(*) AS symbols, count(DISTINCT repo_key) AS repos FROM entries WHERE body_hash <> 0 GROUP BY body_hash HAVING count(*) >= 2",
    "f_path_predicates": f"""{_F} SELECT repo, path, regexp_matches(path, '{predicates.IGNORED_FOLDERS}') AS ignored, regexp_matches(path, '{_TEST}') AS test,
      regexp_matches(path, '{predicates.LOW_PRIORITY}') OR regexp_matches(path, '{_TEST}') AS low, regexp_matches(path, '{predicates.ARTIFACT}') AS artifact,
      CASE WHEN path IS NULL THEN 'unresolved' WHEN regexp_matches(path, '(?i)bench') THEN 'benchmark' WHEN regexp_matches(path, '{_TEST}') THEN 'test' WHEN regexp_matches(path, '(?:^|/)examples?/') THEN 'example' ELSE 'production' END AS caller,
      CASE lower(regexp_extract(path, '\\.(\\w+)$', 1)) """.replace("\\\\", "\\") + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in predicates.EXTENSIONS.items()) + " END AS language, regexp_matches(path, '^(?:.*/)?[^/]*_test\\.go$') AS globbed FROM files",
    "f16_exported": f"{_E} SELECT entry_id, CASE language WHEN 'go' THEN regexp_matches(name, '^[A-Z]') WHEN 'python' THEN NOT starts_with(name, '_') ELSE NOT regexp_matches(name, '^[_#]') END AS exported FROM entries",
    "f10_grep": f"{_F}, {_GREP} SELECT * FROM hits",
    "t5_match_density": f"{_F}, {_GREP} SELECT repo || '/' || path AS file, line, count(*) OVER (PARTITION BY repo, path) AS hits, min(line) OVER (PARTITION BY repo, path) AS first_line FROM hits",
    "j10_innermost": f"""{_F}, {ENTRIES_SQL}, {_GREP}, {_SPANS} SELECT point_id, name FROM (SELECT h.repo || '#' || path || '#' || line AS point_id, name,
      row_number() OVER (PARTITION BY h.repo, path, line ORDER BY end_line - start_line, start_line, name) AS rn FROM hits h JOIN spans s ON s.repo = h.repo AND s.file = h.path AND line BETWEEN start_line AND end_line) WHERE rn = 1""",
    "j12_preceding": f"""{_F}, {ENTRIES_SQL}, {_GREP}, {_SPANS} SELECT point_id, name FROM (SELECT h.repo || '#' || path || '#' || line AS point_id, name,
      row_number() OVER (PARTITION BY h.repo, path, line ORDER BY start_line DESC, name DESC) AS rn FROM hits h JOIN spans s ON s.repo = h.repo AND s.file = h.path AND start_line <= line) WHERE rn = 1""",
    "r3_identifier_parts": f"{_E} SELECT entry_id, array_to_string(list_filter(list_transform(regexp_split_to_array({_CAMEL}, '[^A-Za-z0-9]+'), lambda w: lower(w)), lambda w: length(w) >= 2), ' ') AS parts FROM entries",
}
