"""Queries of imports, layers, cycles, types, hooks, routes in code and hidden uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.operators import duplicates, structure
from cartolith.operators import graph_algorithms as ga
from cartolith.operators import graph_templates as gt
from cartolith.plans.graph_queries import _IMPORTS, _PR, _SURPRISE, W, ranked_graph
from cartolith.plans.quality_queries import _CALLS, call_sites
from cartolith.session import table
from cartolith.sources import code_routes, scanners
from cartolith.sources.routes import HOOKS_SQL, ROUTES_SQL, hooks, routes
from cartolith.sources.tables import ENTRIES_SQL, FILES_SQL, Graph, entries, files, package_of, package_sql, snapshot_graphs

FOCUS = "pkg"
STANDARD = ["print", "len", "append", "make", "panic", "Error", "ValueError"]


def _package_edges(g: Graph) -> DataFrame:
    return gt.imports(g).select("graph", package_of(F.col("file")).alias("src"), F.col("package").alias("dst")).distinct()


def _aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("code_df4de51e", "crate", "src"), ("code_df4de51e", "$lib", "src/lib")], "repo string, prefix string, root string")


def x7_resolved_imports(spark: SparkSession, folder: str) -> DataFrame:
    own = files(spark, folder)
    return structure.resolved_imports(scanners.import_rows(own), own, _aliases(spark))


def x8_imported_by(spark: SparkSession, folder: str) -> DataFrame:
    return structure.imported_by(x7_resolved_imports(spark, folder))


def _route_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Source files made of the links in documents: a line for each route that a kind of document serves or calls."""
    own = routes(spark, folder).select("symbol", "file", "side", "path").where(~F.col("path").rlike("[\"'`\\\\<{:?#$]")).distinct()
    line = F.when(F.col("side") == "server", F.concat(F.lit('app.get("'), "path", F.lit('", '), "symbol", F.lit(")"))).otherwise(F.concat(F.lit('axios.get("'), "path", F.lit('")')))
    code = own.groupBy("side", "symbol", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), "\n").alias("content"))
    return code.select("side", F.col("symbol").alias("repo"), F.concat_ws("#", "side", "file").alias("path"), F.lit("javascript").alias("language"), "content")


def x24_code_routes(spark: SparkSession, folder: str) -> DataFrame:
    return code_routes.code_routes(_route_sources(spark, folder))


def j25_route_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """What the routes of a serving and a calling file prove, of all pairs of files that meet in a path."""
    found = x24_code_routes(spark, folder)
    met = gt.cross_calls(found.select(F.col("repo").alias("symbol"), "file", "method", "path", "side"))
    pairs = met.select(F.col("server").alias("repo_a"), F.col("server_file").alias("file_a"), F.col("client").alias("repo_b"), F.col("client_file").alias("file_b"))
    return code_routes.route_evidence(pairs, found)


def j30_handler_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Handlers by their name, callers by the function around the call: one of three lines heads each file."""
    own = _route_sources(spark, folder).select("repo", F.col("path").alias("file"), "side")
    symbols = own.select("repo", "file", F.when(F.col("side") == "server", F.col("repo")).otherwise("load").alias("name"), F.lit(1).alias("start_line"), F.lit(3).alias("end_line"))
    return code_routes.handler_edges(x24_code_routes(spark, folder), symbols)


def _copied_files(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of files of different repositories that hold an exact copy of a symbol."""
    own = entries(spark, folder)
    linked = duplicates.exact_members(own)
    ends = [own.select(F.col("entry_id").alias(i), F.col("repo_key").alias(f"repo_{s}"), F.col("file").alias(f"file_{s}")) for i, s in (("first_id", "a"), ("entry_id", "b"))]
    return linked.join(ends[0], "first_id").join(ends[1], "entry_id").where("repo_a <> repo_b").select("repo_a", "file_a", "repo_b", "file_b").distinct()


def j26_token_evidence(spark: SparkSession, folder: str) -> DataFrame:
    tokens = entries(spark, folder).where("body IS NOT NULL").select("repo_key", "file", F.explode(F.regexp_extract_all("body", F.lit(r"\b[A-Za-z_]\w{7,}"), F.lit(0))).alias("t"))
    own = tokens.groupBy(F.col("repo_key").alias("repo"), "file").agg(F.collect_set("t").alias("tokens"))
    found = code_routes.token_evidence(_copied_files(spark, folder), own)
    return found.withColumn("shared", F.array_join("shared", ","))


def g17_package_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return structure.package_cycles(_package_edges(snapshot_graphs(spark, folder)), 3)


def g17_has_cycle(spark: SparkSession, folder: str) -> DataFrame:
    calls = snapshot_graphs(spark, folder).calls()
    return structure.has_cycle(calls.select("graph", F.concat_ws("\0", "src", "src_file").alias("src"), F.concat_ws("\0", "dst", "dst_file").alias("dst")))


def g18_focused(spark: SparkSession, folder: str) -> DataFrame:
    return structure.focused_packages(_package_edges(snapshot_graphs(spark, folder)), FOCUS, 2)


def g20_community_overview(spark: SparkSession, folder: str) -> DataFrame:
    g = snapshot_graphs(spark, folder)
    return structure.community_overview(g.symbols.where("community IS NOT NULL").select("graph", "name", "file", F.col("community").alias("detected")))


def g20_detected_overview(spark: SparkSession, folder: str) -> DataFrame:
    return structure.community_overview(ga.louvain(snapshot_graphs(spark, folder, stage=True)))


def _surprise(g: Graph) -> DataFrame:
    return ga.surprise_scores(g, ranked_graph(g).withColumn("pagerank", F.round("pagerank", 9)))


def g22_graph_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of high surprise, and those whose community is not the same in all snapshots of their repository."""
    g = snapshot_graphs(spark, folder, stage=True)
    moved = g.symbols.groupBy("repo", "name", "file").agg(F.count_distinct("community").alias("n")).where("n > 1")
    moved = g.symbols.join(moved, ["repo", "name", "file"], "left_semi")
    return structure.graph_flags(g.symbols, moved, ga.node_surprise(_surprise(g)))


def x17_new_insights(spark: SparkSession, folder: str) -> DataFrame:
    """Ends of surprising calls; those of constants are known already."""
    g = snapshot_graphs(spark, folder, stage=True)
    known = g.symbols.where("kind = 'const'").select("name", "file", F.lit("surprise").alias("flag")).distinct()
    return structure.new_insights(_surprise(g), known, 3, "surprise")


def a2_god_packages(spark: SparkSession, folder: str) -> DataFrame:
    return structure.god_packages(_package_edges(snapshot_graphs(spark, folder)), 3)


def a8_abstraction(spark: SparkSession, folder: str) -> DataFrame:
    """Structs of a community divisible by three stand for interfaces, of which the graphs have none."""
    kind = F.when((F.col("kind") == "struct") & (F.col("community") % 3 == 0), "interface").otherwise(F.col("kind"))
    return structure.abstraction(snapshot_graphs(spark, folder).symbols.withColumn("kind", kind))


def a20_roots_and_leaves(spark: SparkSession, folder: str) -> DataFrame:
    return structure.roots_and_leaves(_package_edges(snapshot_graphs(spark, folder)))


def x3_template_users(spark: SparkSession, folder: str) -> DataFrame:
    return structure.template_users(snapshot_graphs(spark, folder).edges, "scoreAnchor87")


def x5_hidden_callers(spark: SparkSession, folder: str) -> DataFrame:
    """Functions that mention a struct of their repository."""
    own = entries(spark, folder).withColumn("repo", F.col("repo_key"))
    return structure.hidden_callers(own.where(F.col("kind").isin("function", "method")), own.where("kind = 'struct'").select("repo", F.col("name").alias("target")))


def x6_without_string_uses(spark: SparkSession, folder: str) -> DataFrame:
    """Constants that no function mentions."""
    own = entries(spark, folder).withColumn("repo", F.col("repo_key"))
    names = own.where("kind = 'const' AND repo IS NOT NULL AND name IS NOT NULL").select("repo", "name").distinct()
    return structure.without_string_uses(names, own.where(F.col("kind").isin("function", "method")), None)


def j29_type_edges(spark: SparkSession, folder: str) -> DataFrame:
    g = snapshot_graphs(spark, folder)
    kind = F.when(F.col("label") == "IMPLEMENTS", "implements").otherwise("extends")
    relations = g.edges.where(F.col("label").isin("IMPLEMENTS", "INHERITS")).select(
        F.col("graph").alias("repo"), F.col("src").alias("subject"), F.col("dst").alias("target"), kind.alias("kind"), F.col("src_file").alias("file")
    )
    return structure.type_edges(relations, g.symbols.select(F.col("graph").alias("repo"), "name", "file"))


LAYERS = (("web", "src", 1), ("core", "internal", 2), ("tools", "cmd/", 3), ("rest", ".", 4))


def j31_layers(spark: SparkSession, folder: str) -> DataFrame:
    own = files(spark, folder).where("repo IS NOT NULL AND path IS NOT NULL").select("repo", "path")
    named = spark.createDataFrame(list(LAYERS), "layer string, root string, place int")
    return scanners.assigned_layers(own, own.select("repo").distinct().join(F.broadcast(named)))  # four rows


def j32_hook_edges(spark: SparkSession, folder: str) -> DataFrame:
    own = hooks(routes(spark, folder)).withColumn("repo", F.lit("r"))
    fires = own.where("side = 'client'").select("repo", F.col("path").alias("hook"))
    handlers = own.where("side = 'server'").select("repo", F.col("path").alias("hook"), F.col("symbol").alias("callback"))
    return structure.hook_edges(fires, handlers, own.select("repo", F.col("symbol").alias("name"), "file"))


def j33_merged_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Typed uses before calls, of each pair of symbols one edge."""
    g = snapshot_graphs(spark, folder)
    keys = ["graph", "src", "src_file", "dst", "dst_file"]
    return structure.merged_calls([g.edges.where(F.col("label") == x).select(*keys, "label") for x in ("USES", "CALLS")], keys)


def f19_without_standard(spark: SparkSession, folder: str) -> DataFrame:
    sites = call_sites(spark, folder)
    homes = entries(spark, folder).groupBy(F.col("repo_key").alias("repo"), F.col("name").alias("callee")).agg(F.min("file").alias("callee_file"))
    return structure.without_standard(sites.join(homes, ["repo", "callee"], "left"), STANDARD)


def i10_downstream(spark: SparkSession, folder: str) -> DataFrame:
    return _walk(spark, folder, False, 1)


def i10_upstream(spark: SparkSession, folder: str) -> DataFrame:
    return _walk(spark, folder, True, 3)


def _walk(spark: SparkSession, folder: str, backward: bool, top: int) -> DataFrame:
    """Investigations are graphs, suspects their most complex functions."""
    from pyspark.sql import Window

    g = snapshot_graphs(spark, folder)
    order = Window.partitionBy("graph").orderBy(F.desc("complexity"), "name", "file")
    placed = g.symbols.where("kind = 'function'").select(F.col("graph").alias("investigation_id"), F.col("name").alias("subject"), F.row_number().over(order).alias("place"))
    return structure.upstream_walk(placed, g.calls(), backward, top, 2)


def a23_freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Parts stand for dependencies: their brand for the repository, their type for the name, size and price for versions."""
    part = table(spark, folder, "part")
    version = F.concat(F.lit("v"), F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"))
    own = part.select(F.col("p_brand").alias("repo"), F.lit("x").alias("ecosystem"), F.col("p_type").alias("name"), version.alias("version"))
    latest = part.groupBy(F.lit("x").alias("ecosystem"), F.col("p_type").alias("name")).agg(F.concat(F.floor(F.max("p_size") / 10).cast("string"), F.lit(".3.0")).alias("latest"))
    weak = own.where("version = 'v1.1'").select("ecosystem", "name", "version")
    return structure.freshness(own, latest, weak)


QUERIES = {
    f.__name__: f
    for f in (
        x7_resolved_imports, x8_imported_by, x24_code_routes, j25_route_evidence, j30_handler_edges, j26_token_evidence, g17_package_cycles, g17_has_cycle, g18_focused, g20_community_overview,
        g20_detected_overview, g22_graph_flags, x17_new_insights, a2_god_packages, a8_abstraction, a20_roots_and_leaves, x3_template_users, x5_hidden_callers,
        x6_without_string_uses, j29_type_edges, j31_layers, j32_hook_edges, j33_merged_calls, f19_without_standard, i10_downstream, i10_upstream, a23_freshness,
    )
}

_PACKAGES = "pk AS MATERIALIZED (SELECT DISTINCT graph, " + package_sql("file") + " AS src, package AS dst FROM imports)"
_G = W + "," + _IMPORTS + ", " + _PACKAGES
_FOUND = r"""found AS MATERIALIZED (SELECT DISTINCT repo, file, regexp_replace(regexp_replace(m, '^\s*(?:import\s+.*from\s+|import\s+(?:\w+\s+)?|from\s+|use\s+)', ''), '["'']', '', 'g') AS target FROM (
    SELECT repo, file, regexp_extract(text, '^\s*(?:import\s+(?:\w+\s+)?"([^"]+)"|import\s+.*from\s+["'']([^"'']+)["'']|(?:import|from)\s+([\w.]+)|use\s+([\w:]+))', 0) AS m FROM (
      SELECT repo, path AS file, unnest(string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS text FROM files WHERE content IS NOT NULL)) WHERE m <> '')"""
_ENDINGS = "[" + ", ".join(f"'{e}'" for e in structure.ENDINGS) + "]"
_RESOLVED = rf"""{FILES_SQL}, {_FOUND},
  based AS (SELECT *, CASE how WHEN 'alias' THEN 'src' || CASE WHEN trim(substr(target, 6), ':/') = '' THEN '' ELSE '/' || trim(substr(target, 6), ':/') END
      WHEN 'relative' THEN regexp_replace({package_sql('file')} || '/' || regexp_replace(target, '^(\./)+', ''), '^\./', '')
      WHEN 'package' THEN regexp_replace(regexp_replace(target, '::', '/', 'g'), '(\w)\.', '\1/', 'g') END AS base FROM (
    SELECT *, CASE WHEN starts_with(target, 'virtual:') THEN 'virtual' WHEN repo = 'code_df4de51e' AND (target = 'crate' OR starts_with(target, 'crate/')) THEN 'alias' WHEN starts_with(target, '.') THEN 'relative' ELSE 'package' END AS how FROM found)),
  asked AS (SELECT b.*, base || {_ENDINGS}[o] AS resolved, o FROM based b, unnest(range(1, {len(structure.ENDINGS) + 1})) AS t(o)),
  resolved AS MATERIALIZED (SELECT b.repo, b.file, b.target, b.how, r.resolved FROM based b LEFT JOIN (
    SELECT repo, file, target, min_by(resolved, o) AS resolved FROM asked WHERE (repo, resolved) IN (SELECT (repo, path) FROM files) GROUP BY ALL) r
    ON r.repo IS NOT DISTINCT FROM b.repo AND r.file = b.file AND r.target = b.target)"""
_WALK = """placed AS (SELECT graph AS id, name, row_number() OVER (PARTITION BY graph ORDER BY complexity DESC, name, file) AS place FROM symbols WHERE kind = 'function'),
  step AS MATERIALIZED (SELECT DISTINCT {a} AS name, {b} AS next FROM calls), f0 AS MATERIALIZED (SELECT DISTINCT id, name FROM placed WHERE place <= {top}),
  f1 AS MATERIALIZED (SELECT DISTINCT id, next AS name FROM f0 JOIN step USING (name) WHERE (id, next) NOT IN (SELECT (id, name) FROM f0)),
  f2 AS (SELECT DISTINCT id, next AS name FROM f1 JOIN step USING (name) WHERE (id, next) NOT IN (SELECT (id, name) FROM f0 UNION ALL SELECT (id, name) FROM f1))
  SELECT id AS investigation_id, name, distance, round(0.3 / distance, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, name) AS rn FROM (SELECT id, name, 1 AS distance FROM f1 UNION ALL SELECT id, name, 2 FROM f2)) WHERE rn <= 9"""
_JUNK = "len(regexp_replace(path, '^/', '')) = 1 AND path <> '/*' OR regexp_matches(path, '^/[0-9a-fA-F]{24,}$') OR lower(substr(path, 2)) IN (" + ", ".join(f"'{h}'" for h in code_routes.HEADERS) + ")"
_CODE_ROUTES = ROUTES_SQL + f""", coded AS MATERIALIZED (SELECT symbol AS repo, side || '#' || file AS file, row_number() OVER (PARTITION BY side, symbol, file ORDER BY path)::INT AS line, 'GET' AS method, path,
    CASE WHEN side = 'server' THEN symbol END AS handler, side, CASE WHEN side = 'server' THEN 'express' ELSE 'axios' END AS framework
  FROM (SELECT DISTINCT symbol, file, side, path FROM routes WHERE NOT regexp_matches(path, '["''`\\\\<{{:?#$]'))),
  kept AS MATERIALIZED (SELECT * FROM coded WHERE NOT ({_JUNK}))"""
_E = "WITH " + ENTRIES_SQL
_MENTIONS = r"""own AS (SELECT repo_key AS repo, file, name AS caller, body FROM entries WHERE kind IN ('function', 'method') AND body IS NOT NULL),
  said AS (SELECT DISTINCT repo, file, caller, target, c FROM (
    SELECT repo, file, caller, unnest(regexp_extract_all(regexp_replace(body, '"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''', ' ', 'g'), '[A-Za-z_]\w*')) AS target, 0.6 AS c FROM own
    UNION ALL SELECT repo, file, caller, unnest(regexp_extract_all(body, '["'']([A-Za-z_]\w*)["'']', 1)), 0.4 FROM own))"""
SQL = {
    "x7_resolved_imports": f"WITH {_RESOLVED} SELECT repo, file, target, how, resolved FROM resolved",
    "x8_imported_by": f"""WITH {_RESOLVED}, used AS (SELECT DISTINCT repo, {package_sql('file')} AS importer, {package_sql('resolved')} AS package FROM resolved WHERE resolved IS NOT NULL)
      SELECT r.repo, r.file, coalesce(n, 0) AS packages FROM (SELECT DISTINCT repo, resolved AS file, {package_sql('resolved')} AS package FROM resolved WHERE resolved IS NOT NULL) r
      LEFT JOIN (SELECT repo, package, count(*) AS n FROM used WHERE importer <> package GROUP BY ALL) u ON u.repo = r.repo AND u.package = r.package""",
    "x24_code_routes": f"WITH {_CODE_ROUTES} SELECT * FROM kept",
    "j25_route_evidence": f"""WITH {_CODE_ROUTES} SELECT DISTINCT s.repo AS repo_a, s.file AS file_a, c.repo AS repo_b, c.file AS file_b, 'GET' AS method, s.path FROM kept s JOIN kept c ON s.path = c.path AND s.side = 'server' AND c.side = 'client'
      WHERE len(list_filter(string_split(s.path, '/'), lambda x: x NOT IN ('', '*'))) >= 2""",
    "j30_handler_edges": f"WITH {_CODE_ROUTES} SELECT DISTINCT repo, CASE WHEN side = 'server' THEN repo ELSE 'load' END AS symbol, file AS symbol_file, CASE WHEN side = 'server' THEN 'HANDLES' ELSE 'FETCHES' END AS relation, method, path FROM kept WHERE side = 'server' OR line <= 3",
    "j26_token_evidence": rf"""{_E}, link AS (SELECT min(entry_id) OVER (PARTITION BY body_hash) AS first_id, entry_id FROM entries WHERE body_hash <> 0),
      pr AS (SELECT DISTINCT a.repo_key AS repo_a, a.file AS file_a, b.repo_key AS repo_b, b.file AS file_b FROM link l JOIN entries a ON a.entry_id = l.first_id JOIN entries b ON b.entry_id = l.entry_id WHERE a.repo_key <> b.repo_key AND a.entry_id <> b.entry_id),
      tk AS MATERIALIZED (SELECT repo_key AS repo, file, list(DISTINCT t) AS tokens FROM (SELECT repo_key, file, unnest(regexp_extract_all(body, '\b[A-Za-z_]\w{{7,}}')) AS t FROM entries WHERE body IS NOT NULL) GROUP BY ALL)
      SELECT repo_a, file_a, repo_b, file_b, array_to_string(list_sort(list_intersect(x.tokens, y.tokens))[1:5], ',') AS shared FROM pr JOIN tk x ON x.repo = repo_a AND x.file = file_a JOIN tk y ON y.repo = repo_b AND y.file = file_b
      WHERE len(list_intersect(x.tokens, y.tokens)) > 0""",
    "g17_package_cycles": _G + """ SELECT a.graph, a.src || ' > ' || a.dst AS cycle FROM pk a JOIN pk b ON b.graph = a.graph AND b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst
      UNION ALL SELECT a.graph, a.src || ' > ' || a.dst || ' > ' || b.dst FROM pk a JOIN pk b ON b.graph = a.graph AND b.src = a.dst JOIN pk c ON c.graph = b.graph AND c.src = b.dst AND c.dst = a.src
      WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst""",
    "g18_focused": _G + f", k0 AS (SELECT DISTINCT graph, src, dst FROM pk WHERE contains(src, '{FOCUS}')) SELECT graph, src, dst FROM k0 UNION SELECT p.graph, p.src, p.dst FROM pk p JOIN k0 ON k0.graph = p.graph AND k0.dst = p.src",
    "g20_community_overview": W + """, m AS (SELECT graph, community, name, row_number() OVER (PARTITION BY graph, community ORDER BY name, file) AS k, count(*) OVER (PARTITION BY graph, community) AS size FROM symbols WHERE community IS NOT NULL),
      r AS (SELECT graph, community, max(size) AS size, string_agg(name, ',' ORDER BY k) FILTER (k <= 5) AS names FROM m WHERE size >= 3 GROUP BY ALL)
      SELECT graph, community, size, names FROM (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY size DESC, community) AS place FROM r) WHERE place <= 10""",
    "g22_graph_flags": _PR + _SURPRISE + """, moved AS (SELECT repo, name, file FROM symbols GROUP BY ALL HAVING count(DISTINCT community) > 1),
      high AS (SELECT graph, name, file FROM (SELECT graph, src AS name, src_file AS file, score FROM scores UNION ALL SELECT graph, dst, dst_file, score FROM scores) GROUP BY ALL HAVING round(max(score) / 6, 6) >= 0.5)
      SELECT graph, name, file, 'community_move' AS flag FROM symbols WHERE (repo, name, file) IN (SELECT (repo, name, file) FROM moved)
      UNION ALL SELECT graph, name, file, 'high_surprise' FROM symbols WHERE (graph, name, file) IN (SELECT (graph, name, file) FROM high)""",
    "x17_new_insights": _PR + _SURPRISE + """SELECT DISTINCT name, file, 'surprise' AS flag FROM (SELECT src AS name, src_file AS file, score FROM scores UNION ALL SELECT dst, dst_file, score FROM scores)
      WHERE score >= 3 AND (name, file) NOT IN (SELECT (name, file) FROM symbols WHERE kind = 'const')""",
    "a2_god_packages": _G + " SELECT graph, dst AS package, count(DISTINCT src) AS importers FROM pk WHERE src <> dst GROUP BY ALL HAVING count(DISTINCT src) >= 3",
    "a8_abstraction": W + """SELECT graph, count(*) FILTER (i) AS interfaces, round(coalesce(count(*) FILTER (i) / nullif(count(*) FILTER (kind = 'struct'), 0), 0), 6) AS interface_ratio, count(DISTINCT community) AS communities
      FROM (SELECT *, coalesce(kind = 'struct' AND community % 3 = 0, false) AS i FROM symbols) GROUP BY graph""",
    "a20_roots_and_leaves": _G + """ SELECT DISTINCT graph, src AS package, 'root' AS place FROM pk p WHERE NOT EXISTS (SELECT 1 FROM pk q WHERE q.graph = p.graph AND q.dst = p.src)
      UNION ALL SELECT DISTINCT graph, dst, 'leaf' FROM pk p WHERE NOT EXISTS (SELECT 1 FROM pk q WHERE q.graph = p.graph AND q.src = p.dst)""",
    "x3_template_users": W + "SELECT DISTINCT graph, src AS name, src_file AS file, 1 AS distance FROM edges WHERE label = 'USES' AND dst = 'scoreAnchor87'",
    "x5_hidden_callers": f"{_E}, {_MENTIONS} SELECT target, repo, file, caller, max(c)::DOUBLE AS confidence FROM said WHERE caller <> target AND (repo, target) IN (SELECT (repo_key, name) FROM entries WHERE kind = 'struct') GROUP BY ALL",
    "x6_without_string_uses": f"{_E}, {_MENTIONS} SELECT DISTINCT repo_key AS repo, name FROM entries e WHERE kind = 'const' AND repo_key IS NOT NULL AND name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM said s WHERE s.repo = e.repo_key AND s.target = e.name AND s.caller <> s.target)",
    "j29_type_edges": W + f""", r AS (SELECT DISTINCT graph, src, src_file, dst, label FROM edges WHERE label IN ('IMPLEMENTS', 'INHERITS')), h AS (SELECT DISTINCT graph, name, file FROM symbols)
      SELECT graph AS repo, src, src_file, dst, label, dst_file FROM (SELECT r.*, h.file AS dst_file, row_number() OVER (PARTITION BY r.graph, src, src_file, dst, label ORDER BY {package_sql('src_file')} <> {package_sql('h.file')},
        len(list_filter(range(1, least(len(string_split(src_file, '/')), len(string_split(h.file, '/'))) + 1), lambda i: string_split(src_file, '/')[1:i] = string_split(h.file, '/')[1:i])) DESC, h.file) AS rn
        FROM r JOIN h ON h.graph = r.graph AND h.name = r.dst) WHERE rn = 1""",
    "j31_layers": f"WITH {FILES_SQL} SELECT DISTINCT repo, path, CASE WHEN path = 'src' OR starts_with(path, 'src/') THEN 'web' WHEN path = 'internal' OR starts_with(path, 'internal/') THEN 'core' WHEN path = 'cmd' OR starts_with(path, 'cmd/') THEN 'tools' ELSE 'rest' END AS layer FROM files WHERE repo IS NOT NULL AND path IS NOT NULL",
    "j32_hook_edges": "WITH " + ROUTES_SQL + "," + HOOKS_SQL + " SELECT DISTINCT 'r' AS repo, h.path AS hook, NULL::VARCHAR AS caller, h.symbol AS callee, s.file AS callee_file FROM hooks h JOIN (SELECT DISTINCT symbol, file FROM hooks) s USING (symbol) WHERE side = 'server'",
    "j33_merged_calls": W + "SELECT graph, src, src_file, dst, dst_file, CASE WHEN bool_or(label = 'USES') THEN 'USES' ELSE 'CALLS' END AS label FROM edges WHERE label IN ('USES', 'CALLS') GROUP BY ALL",
    "f19_without_standard": f"{_E}, {_CALLS} SELECT s.repo, caller_file, s.callee, f AS callee_file FROM call_sites s LEFT JOIN (SELECT repo, callee, min(file) AS f FROM homes GROUP BY ALL) h ON h.repo = s.repo AND h.callee = s.callee WHERE f IS NOT NULL OR s.callee NOT IN (" + ", ".join(f"'{x}'" for x in STANDARD) + ")",
    "i10_downstream": W + "," + _WALK.format(a="src", b="dst", top=1),
    "i10_upstream": W + "," + _WALK.format(a="dst", b="src", top=3),
    "a23_freshness": """WITH own AS (SELECT p_brand AS repo, p_type AS name, p_size // 10 AS major, p_size % 10 AS minor FROM part), newest AS (SELECT p_type AS name, max(p_size) // 10 AS latest FROM part GROUP BY 1),
      weak AS (SELECT DISTINCT name FROM own WHERE major = 1 AND minor = 1),
      c AS (SELECT o.repo, CASE WHEN latest > major THEN 'major' WHEN latest < major THEN 'current' WHEN 3 > minor THEN 'minor' ELSE 'current' END AS change, major = 1 AND minor = 1 AS weak FROM own o JOIN newest USING (name))
      SELECT repo, count(*) AS total_deps, count(*) FILTER (change = 'major') AS major, count(*) FILTER (change = 'minor') AS minor, 0::BIGINT AS patch,
        round(count(*) FILTER (change = 'current') / count(*), 6) AS fresh_ratio, round(1 - count(*) FILTER (weak) / count(*), 6) AS secure_ratio FROM c GROUP BY repo""",
}
