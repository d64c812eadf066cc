"""Queries over the snapshot graphs: named templates, rankings, traversals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.operators import graph_algorithms as ga
from cartolith.operators import graph_templates as gt
from cartolith.session import cut_lineage
from cartolith.sources.routes import HOOKS_SQL, ROUTES_SQL, hooks, routes
from cartolith.sources.tables import ENTRIES_SQL, GRAPH_SQL, Graph, entries, package_sql, snapshot_graphs

Query = Callable[[SparkSession, str], DataFrame]
#: Symbols, a folder and a route that the queries with parameters name.
START, END, FOLDER, ROUTE = "scoreAnchor87", "walkLedger47", "pkg", "/api"


def _graph(run: Callable[[Graph], DataFrame], stage: bool = False) -> Query:
    return lambda spark, folder: run(snapshot_graphs(spark, folder, stage))


def _routes(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: run(routes(spark, folder))


def ranked_graph(g: Graph, rounds: int = 20) -> DataFrame:
    """PageRank over calls, staged because several consumers read it."""
    return cut_lineage(ga.pagerank(g.symbols, g.calls(), rounds=rounds), "pagerank")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _pagerank(g: Graph) -> DataFrame:
    return _rounded(ga.pagerank(g.symbols, g.calls()), "pagerank")


def _seeds(g: Graph) -> DataFrame:
    """Every struct as a seed of weight 1."""
    return g.symbols.where(F.col("kind") == "struct").select("graph", "name", "file", F.lit(1.0).alias("seed"))


def _weighted(g: Graph) -> DataFrame:
    weight = F.lit(0.0)
    for label, w in ga.LABEL_WEIGHTS.items():
        weight = F.when(F.col("label") == label, w).otherwise(weight)
    return g.edges.withColumn("w", weight).where("w > 0")


def _with_rank(run: Callable[[DataFrame, Graph], DataFrame]) -> Query:
    return _graph(lambda g: run(ranked_graph(g), g), stage=True)


def _communities(g: Graph) -> DataFrame:
    return gt.communities(g).withColumn("members", F.array_join("members", ","))


QUERIES: dict[str, Query] = {
    "j1_who_calls": _graph(gt.who_calls),
    "j1_calls_of": _graph(gt.calls_of),
    "j1_imports_of": _graph(gt.imports_of),
    "j1_importers_of": _graph(gt.importers_of),
    "j1_symbols_in": _graph(gt.symbols_in),
    "j1_depends_on": _graph(gt.depends_on),
    "j1_dependents_of": _graph(gt.dependents_of),
    "j2_cross_calls": _routes(gt.cross_calls),
    "j3_api_routes": _routes(gt.api_routes),
    "j3_inherits": _graph(gt.inherits),
    "j3_implementations": _graph(gt.implementations),
    "j4_layer_deps": _graph(gt.layer_deps),
    "j5_type_hierarchy": _graph(gt.type_hierarchy),
    "j5_polyglot_overview": lambda spark, folder: gt.polyglot_overview(
        entries(spark, folder).select(
            F.substring_index("file", "/", 1).alias("layer"), F.col("kind").alias("role"), "language", "file"
        ).distinct(),
        routes(spark, folder),
    ),
    "j6_dead_code": _graph(gt.dead_code),
    "j8_call_chain": _graph(lambda g: ga.paths(g.calls(), 10), stage=True),
    "j8_call_chain_between": _graph(lambda g: ga.paths(g.calls(), 10, START, END), stage=True),
    "j8_subtypes": _graph(lambda g: ga.paths(g.edges.where(F.col("label") == "INHERITS"), 5), stage=True),
    "j9_call_depth": _graph(lambda g: ga.longest_chain(g.calls()), stage=True),
    "a1_most_connected": _graph(gt.most_connected),
    "a3_communities": _graph(_communities),
    "a3_community_members": _graph(gt.community_members),
    "a4_hotspot_files": _with_rank(lambda r, g: _rounded(gt.hotspot_files(r), "max_pagerank")),
    "a9_two_cycles": _graph(lambda g: ga.two_cycles(gt.imports(g))),
    "t1_complex_symbols": _graph(lambda g: gt.complex_symbols(g, 20)),
    "t1_hotspots": lambda spark, folder: gt.hotspots(entries(spark, folder), 20),
    "t1_important_symbols": _with_rank(lambda r, g: _rounded(gt.important_symbols(r, g.symbols), "pagerank")),
    "t1_explain_architecture": _with_rank(lambda r, g: _rounded(gt.explain_architecture(r, g.symbols), "pagerank")),
    "w4_structural_rank": _with_rank(lambda r, g: gt.structural_rank(r.withColumn("pagerank", F.round("pagerank", 9)))),
    "g_surprise_candidates": _graph(gt.surprise_candidates),
    "g_hook_handlers": _routes(lambda r: gt.hook_handlers(hooks(r))),
    "g_hook_fires": _routes(lambda r: gt.hook_fires(hooks(r))),
    "g_all_hooks": _routes(lambda r: gt.all_hooks(hooks(r))),
    "g1_pagerank": _graph(_pagerank, stage=True),
    "g2_personalized_pagerank": _graph(lambda g: _rounded(ga.pagerank(g.symbols, g.calls(), _seeds(g)), "pagerank"), stage=True),
    "g3_weighted_pagerank": _graph(
        lambda g: _rounded(ga.pagerank(g.symbols, _weighted(g), _seeds(g), weight="w"), "pagerank"), stage=True
    ),
    "g4_louvain": _graph(lambda g: ga.louvain(g, weighted=False), stage=True),
    "g5_louvain_weighted": _graph(ga.louvain, stage=True),
    "g6_surprise": _with_rank(lambda r, g: ga.surprise_scores(g, r.withColumn("pagerank", F.round("pagerank", 9)))),
    "a5_node_surprise": _with_rank(
        lambda r, g: ga.node_surprise(ga.surprise_scores(g, r.withColumn("pagerank", F.round("pagerank", 9))))
    ),
    "g7_top_surprises": _with_rank(
        lambda r, g: ga.surprise_scores(g, r.withColumn("pagerank", F.round("pagerank", 9)))
        .where("score > 0")
        .orderBy(F.desc("score"), "graph", "src", "src_file", "dst", "dst_file")
        .limit(10)
    ),
    "g8_trace": _graph(lambda g: ga.trace_tree(g.calls(), 5, symbols=g.symbols), stage=True),
    "g8_trace_callers": _graph(lambda g: ga.trace_tree(g.calls(), 5, root=END, callers=True, symbols=g.symbols), stage=True),
    "g9_trace_bfs": _graph(lambda g: ga.reach(g.calls(), g.symbols.where(F.col("kind") == "method"), 5), stage=True),
    "g9_trace_bfs_of": _graph(lambda g: ga.reach(g.calls(), g.symbols.where(F.col("name") == START), 10), stage=True),
    "g10_impact": _graph(ga.impact, stage=True),
    "g10_impact_of": _graph(lambda g: ga.impact(g, name=END), stage=True),
    "g13_flows": _with_rank(
        lambda r, g: ga.flows(g, r.withColumn("pagerank", F.round("pagerank", 9))).withColumn("members", F.array_join("members", ","))
    ),
    "g14_seed_expansion": _graph(lambda g: ga.seed_neighbours(g, g.symbols.where(F.col("kind") == "struct"))),
}


#: Templates with their parameter: function, value, and the condition it puts on the rows of the query without it.
NAMED = {
    "j1_who_calls": (gt.who_calls, END, f"dst = '{END}'"),
    "j1_calls_of": (gt.calls_of, START, f"src = '{START}'"),
    "j1_imports_of": (gt.imports_of, FOLDER, f"contains(file, '{FOLDER}')"),
    "j1_importers_of": (gt.importers_of, FOLDER, f"package = '{FOLDER}'"),
    "j1_symbols_in": (gt.symbols_in, FOLDER, f"contains(file, '{FOLDER}')"),
    "j1_dependents_of": (gt.dependents_of, FOLDER, f"package = '{FOLDER}'"),
    "j3_inherits": (gt.inherits, START, f"child = '{START}'"),
    "j3_implementations": (gt.implementations, END, f"parent = '{END}'"),
    "j5_type_hierarchy": (gt.type_hierarchy, END, f"name = '{END}'"),
    "a3_community_members": (gt.community_members, 3, "community = 3"),
}
QUERIES |= {f"{name}_named": _graph(lambda g, f=f, value=value: f(g, value)) for name, (f, value, _) in NAMED.items()}
QUERIES |= {
    "j1_depends_on_named": _graph(lambda g: gt.depends_on(g, FOLDER)),
    "j2_cross_calls_named": _routes(lambda r: gt.cross_calls(r, ROUTE)),
    "j3_api_routes_named": _routes(lambda r: gt.api_routes(r, ROUTE)),
    "a1_most_connected_top": _graph(lambda g: gt.most_connected(g, 20)),
    "a3_communities_top": _graph(lambda g: gt.communities(g, 10).withColumn("members", F.array_join("members", ","))),
    "a4_hotspot_files_top": _with_rank(lambda r, g: _rounded(gt.hotspot_files(_rounded(r, "pagerank"), 10), "max_pagerank")),
    "t1_important_symbols_top": _with_rank(lambda r, g: gt.important_symbols(_rounded(r, "pagerank"), g.symbols, 15)),
}


def rank_sql(edges: str, jump: str, rounds: int = 20, name: str = "pr") -> str:
    """Chained rounds of PageRank as materialised tables; ``edges`` has a column w, ``jump`` is the teleport share."""
    parts = [
        f"{name}_w AS MATERIALIZED (SELECT graph, src, src_file, dst, dst_file, sum(w) AS w FROM ({edges}) GROUP BY ALL)",
        f"{name}_out AS MATERIALIZED (SELECT graph, src, src_file, sum(w) AS out FROM {name}_w GROUP BY ALL)",
        f"{name}_n AS MATERIALIZED (SELECT s.*, n, {jump} AS jump FROM symbols s JOIN (SELECT graph, count(*)::DOUBLE AS n FROM symbols GROUP BY graph) USING (graph))",
        f"{name}_0 AS MATERIALIZED (SELECT graph, name, file, jump, 1 / n AS r FROM {name}_n)",
    ]
    for k in range(rounds):
        parts.append(
            f"{name}_{k + 1} AS MATERIALIZED (SELECT p.graph, p.name, p.file, p.jump, 0.15 * p.jump + 0.85 * coalesce(l.lost, 0) * p.jump + 0.85 * coalesce(f.flow, 0) AS r"
            f" FROM {name}_{k} p LEFT JOIN (SELECT w.graph, w.dst, w.dst_file, sum(x.r * w.w / o.out) AS flow FROM {name}_{k} x"
            f" JOIN {name}_w w ON x.graph = w.graph AND x.name = w.src AND x.file = w.src_file"
            f" JOIN {name}_out o ON o.graph = w.graph AND o.src = w.src AND o.src_file = w.src_file GROUP BY ALL) f"
            f" ON f.graph = p.graph AND f.dst = p.name AND f.dst_file = p.file"
            f" LEFT JOIN (SELECT x.graph, sum(x.r) AS lost FROM {name}_{k} x LEFT JOIN {name}_out o"
            f" ON o.graph = x.graph AND o.src = x.name AND o.src_file = x.file WHERE o.out IS NULL GROUP BY ALL) l ON l.graph = p.graph)"
        )
    return ",\n".join(parts)


W = "WITH " + GRAPH_SQL
_PR = W + ", " + rank_sql("SELECT *, 1.0 AS w FROM calls", "1 / n") + ", ranked AS (SELECT graph, name, file, r AS pagerank FROM pr_20)"
_SEED = "CASE WHEN s.kind = 'struct' THEN 1.0 / (SELECT count(*) FROM symbols t WHERE t.graph = s.graph AND t.kind = 'struct') ELSE 0 END"
_SEEDED = "coalesce((s.kind = 'struct')::INT / nullif(sum((s.kind = 'struct')::INT) OVER (PARTITION BY s.graph), 0), 0)"
_LABELS = "CASE label WHEN 'CALLS' THEN 3.0 WHEN 'IMPLEMENTS' THEN 2.0 WHEN 'INHERITS' THEN 2.0 WHEN 'TESTED_BY' THEN 1.0 ELSE 0 END"
_PKG_S, _PKG_D = package_sql("src_file"), package_sql("dst_file")
_IMPORTS = f"imports AS (SELECT DISTINCT graph, src_file AS file, {_PKG_D} AS package FROM edges WHERE {_PKG_S} <> {_PKG_D})"
_SURPRISE = f"""
, degree AS (SELECT graph, name, file, count(*) AS degree FROM (SELECT graph, src AS name, src_file AS file FROM calls UNION ALL SELECT graph, dst, dst_file FROM calls) GROUP BY ALL),
about AS (SELECT s.graph, s.name, s.file, s.community, d.degree, round(r.pagerank, 9) AS pr FROM symbols s JOIN degree d USING (graph, name, file) JOIN ranked r USING (graph, name, file)),
scores AS (
  SELECT c.graph, c.src, c.src_file, c.dst, c.dst_file,
    CASE WHEN {_PKG_S} <> {_PKG_D} THEN 2 ELSE 0 END + CASE WHEN a.community <> b.community THEN 1 ELSE 0 END
    + CASE WHEN least(a.degree, b.degree) <= 2 AND greatest(a.degree, b.degree) >= 5 THEN 1 ELSE 0 END
    + CASE WHEN greatest(a.pr, b.pr) / least(a.pr, b.pr) > 10 THEN 1 ELSE 0 END
    + CASE WHEN src_file <> dst_file THEN 1 ELSE 0 END AS score
  FROM calls c JOIN about a ON a.graph = c.graph AND a.name = c.src AND a.file = c.src_file
               JOIN about b ON b.graph = c.graph AND b.name = c.dst AND b.file = c.dst_file)
"""


def paths_sql(edges: str, depth: int, start: str | None = None, end: str | None = None) -> str:
    """Paths without repeated edges by chained joins."""
    begins = f" WHERE src = '{start}'" if start else ""
    ends = f" WHERE dst = '{end}'" if end else ""
    parts = [f"st AS MATERIALIZED (SELECT DISTINCT graph, src, src_file, dst, dst_file, src || chr(0) || src_file || chr(0) || dst || chr(0) || dst_file AS e FROM ({edges}))",
             f"p1 AS (SELECT graph, src, src_file, dst, dst_file, [e] AS used FROM st{begins})"]
    for k in range(2, depth + 1):
        parts.append(
            f"p{k} AS (SELECT p.graph, p.src, p.src_file, s.dst, s.dst_file, list_append(p.used, s.e) AS used FROM p{k - 1} p JOIN st s"
            f" ON s.graph = p.graph AND s.src = p.dst AND s.src_file = p.dst_file WHERE NOT list_contains(p.used, s.e))"
        )
    union = " UNION ".join(f"SELECT graph, src, src_file, dst, dst_file, {k}::INT AS hops FROM p{k}{ends}" for k in range(1, depth + 1))
    return ", " + ",\n".join(parts) + f"\n{union}"


def trace_sql(depth: int, root: str | None = None, callers: bool = False) -> str:
    """Call trees by chained joins, with marks where a path meets itself or leaves the known symbols."""
    key = "{0} || chr(0) || {1}"
    ends = "dst AS src, dst_file AS src_file, src AS dst, src_file AS dst_file" if callers else "src, src_file, dst, dst_file"
    roots = f"src = '{root}'" if root else "NOT EXISTS (SELECT 1 FROM stc t WHERE t.graph = s.graph AND t.dst = s.src AND t.dst_file = s.src_file)"
    also = f" UNION SELECT graph, dst, dst_file FROM stc WHERE dst = '{root}'" if root else ""
    parts = [
        f"std AS MATERIALIZED (SELECT DISTINCT graph, {ends} FROM calls)",
        "stc AS MATERIALIZED (SELECT d.*, y.name IS NULL AS away FROM std d LEFT JOIN (SELECT DISTINCT graph, name, file FROM symbols) y ON y.graph = d.graph AND y.name = d.dst AND y.file = d.dst_file)",
        f"l0 AS (SELECT graph, root, root_file, root AS name, root_file AS file, 0::INT AS depth, [{key.format('root', 'root_file')}] AS path, false AS cycle, false AS unresolved"
        f" FROM (SELECT DISTINCT graph, src AS root, src_file AS root_file FROM stc s WHERE {roots}{also}))",
    ]
    at = key.format("s.dst", "s.dst_file")
    for k in range(1, depth + 1):
        parts.append(
            f"l{k} AS (SELECT l.graph, l.root, l.root_file, s.dst AS name, s.dst_file AS file, {k}::INT AS depth, list_append(l.path, {at}) AS path, list_contains(l.path, {at}) AS cycle, s.away AS unresolved"
            f" FROM l{k - 1} l JOIN stc s ON s.graph = l.graph AND s.src = l.name AND s.src_file = l.file WHERE NOT l.cycle AND NOT l.unresolved)"
        )
    union = " UNION ALL ".join(f"SELECT graph, root, root_file, name, file, depth, cycle, unresolved FROM l{k}" for k in range(depth + 1))
    return ", " + ",\n".join(parts) + "\n" + union


def chain_sql(depth: int, large: int, large_depth: int) -> str:
    """Longest paths without repeated edges: of paths with one end and one set of edges, one is followed."""
    parts = [
        "stp AS MATERIALIZED (SELECT *, row_number() OVER () AS e FROM (SELECT DISTINCT graph, src, src_file, dst, dst_file FROM calls))",
        f"most AS MATERIALIZED (SELECT graph, CASE WHEN count(*) > {large} THEN {min(depth, large_depth)} ELSE {depth} END AS most FROM stp GROUP BY graph)",
        "t1 AS MATERIALIZED (SELECT graph, dst, dst_file, [e] AS used FROM stp)",
    ]
    for k in range(2, depth + 1):
        parts.append(
            f"t{k} AS MATERIALIZED (SELECT DISTINCT t.graph, s.dst, s.dst_file, list_sort(list_append(t.used, s.e)) AS used FROM t{k - 1} t JOIN most m ON m.graph = t.graph AND m.most >= {k}"
            f" JOIN stp s ON s.graph = t.graph AND s.src = t.dst AND s.src_file = t.dst_file WHERE NOT list_contains(t.used, s.e))"
        )
    union = " UNION ALL ".join(f"SELECT DISTINCT graph, {k} AS hops FROM t{k}" for k in range(1, depth + 1))
    return ", " + ",\n".join(parts) + f" SELECT graph, max(hops)::INT AS call_depth FROM ({union}) GROUP BY graph"


def reach_sql(edges: str, seeds: str, depth: int) -> str:
    """Least distances by chained frontiers; ``edges``: graph, a, af, b, bf; ``seeds``: graph, name, file."""
    parts = [
        f"stp AS MATERIALIZED (SELECT DISTINCT * FROM ({edges}))",
        f"k0 AS MATERIALIZED (SELECT DISTINCT graph, name AS seed, file AS seed_file, name, file, 0 AS distance FROM ({seeds}))",
    ]
    for k in range(1, depth + 1):
        known = " UNION ALL ".join(f"SELECT * FROM k{j}" for j in range(k))
        parts.append(
            f"k{k} AS MATERIALIZED (SELECT DISTINCT f.graph, f.seed, f.seed_file, s.b AS name, s.bf AS file, {k} AS distance FROM k{k - 1} f"
            f" JOIN stp s ON s.graph = f.graph AND s.a = f.name AND s.af = f.file"
            f" WHERE NOT EXISTS (SELECT 1 FROM ({known}) o WHERE o.graph = f.graph AND o.seed = f.seed AND o.seed_file = f.seed_file AND o.name = s.b AND o.file = s.bf))"
        )
    return ", " + ",\n".join(parts) + ", reached AS (" + " UNION ALL ".join(f"SELECT * FROM k{k}" for k in range(1, depth + 1)) + ")"


_DOWN = "SELECT graph, src AS a, src_file AS af, dst AS b, dst_file AS bf FROM calls"
_TYPES = "label IN ('INHERITS', 'IMPLEMENTS')"
SQL: dict[str, str] = {
    "j1_who_calls": W + "SELECT DISTINCT graph, dst, dst_file, src AS caller, src_file AS caller_file FROM calls",
    "j1_calls_of": W + "SELECT DISTINCT graph, src, src_file, dst AS callee, dst_file AS callee_file FROM calls",
    "j1_imports_of": W + "," + _IMPORTS + " SELECT * FROM imports",
    "j1_importers_of": W + "," + _IMPORTS + " SELECT graph, package, file FROM imports",
    "j1_symbols_in": W + "SELECT DISTINCT graph, file, name, kind FROM symbols",
    "j1_depends_on": W + "," + _IMPORTS + f" SELECT DISTINCT graph, {package_sql('file')} AS src_package, package FROM imports",
    "j1_dependents_of": W + "," + _IMPORTS + " SELECT DISTINCT graph, package, file FROM imports",
    "j2_cross_calls": "WITH " + ROUTES_SQL + """
        SELECT method, path, server, server_file, client, client_file
        FROM (SELECT DISTINCT method, path, symbol AS server, file AS server_file FROM routes WHERE side = 'server')
        JOIN (SELECT DISTINCT method, path, symbol AS client, file AS client_file FROM routes WHERE side = 'client') USING (method, path)""",
    "j3_api_routes": "WITH " + ROUTES_SQL + "SELECT DISTINCT symbol, file, CASE side WHEN 'server' THEN 'HANDLES' ELSE 'FETCHES' END AS relation, method, path FROM routes",
    "j3_inherits": W + f"SELECT graph, src AS child, dst AS parent, dst_file AS file, label AS relation FROM edges WHERE {_TYPES}",
    "j3_implementations": W + f"SELECT graph, dst AS parent, src AS child, src_file AS file, label AS relation FROM edges WHERE {_TYPES}",
    "j4_layer_deps": W + """
        SELECT graph, from_layer, to_layer, count(*) AS connections FROM (
          SELECT c.graph, split_part(src_file, '/', 1) AS from_layer, split_part(dst_file, '/', 1) AS to_layer FROM calls c
          WHERE EXISTS (SELECT 1 FROM symbols s WHERE s.graph = c.graph AND s.file = c.src_file) AND EXISTS (SELECT 1 FROM symbols s WHERE s.graph = c.graph AND s.file = c.dst_file))
        WHERE from_layer <> to_layer GROUP BY ALL""",
    "j5_type_hierarchy": W + """
        SELECT s.graph, s.name, s.file, p.dst AS parent, c.src AS child FROM symbols s
        LEFT JOIN edges p ON p.label = 'INHERITS' AND p.graph = s.graph AND p.src = s.name AND p.src_file = s.file
        LEFT JOIN edges c ON c.label = 'INHERITS' AND c.graph = s.graph AND c.dst = s.name AND c.dst_file = s.file""",
    "j5_polyglot_overview": "WITH " + ENTRIES_SQL + "," + ROUTES_SQL + """
        SELECT layer, role, language, count(DISTINCT l.file) AS files, count(DISTINCT r.path) AS routes FROM (
          SELECT DISTINCT split_part(file, '/', 1) AS layer, kind AS role, language, file FROM entries) l
        LEFT JOIN routes r ON r.side = 'server' AND r.file = l.file GROUP BY ALL""",
    "j6_dead_code": W + """
        SELECT graph, name, file FROM symbols s WHERE kind = 'function'
        AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.graph = s.graph AND c.dst = s.name AND c.dst_file = s.file)""",
    "j8_call_chain": W + paths_sql("SELECT * FROM calls", 10),
    "j8_call_chain_between": W + paths_sql("SELECT * FROM calls", 10, START, END),
    "j8_subtypes": W + paths_sql("SELECT * FROM edges WHERE label = 'INHERITS'", 5),
    "j9_call_depth": W + chain_sql(10, 8000, 6),
    "a1_most_connected": W + """
        SELECT s.graph, s.name, s.kind, s.file, count(*) AS call_count FROM symbols s JOIN calls c
        ON c.graph = s.graph AND c.dst = s.name AND c.dst_file = s.file GROUP BY ALL""",
    "a3_communities": W + "SELECT graph, community, count(*) AS size, string_agg(name, ',' ORDER BY name) AS members FROM symbols WHERE community IS NOT NULL GROUP BY ALL",
    "a3_community_members": W + "SELECT graph, community, name, kind, file FROM symbols",
    "a4_hotspot_files": _PR + "SELECT graph, file, round(max(pagerank), 6) AS max_pagerank, count(*) AS symbols FROM ranked GROUP BY ALL",
    "a9_two_cycles": W + "," + _IMPORTS + rf""", pairs AS (SELECT DISTINCT graph, {package_sql('file')} AS a, package AS b FROM imports
        WHERE NOT regexp_matches(file, '_test\.|\.test\.|\.spec\.|(^|/)tests?/'))
        SELECT p.graph, p.a, p.b FROM pairs p JOIN pairs q ON q.graph = p.graph AND q.a = p.b AND q.b = p.a WHERE p.a < p.b""",
    "t1_complex_symbols": W + "SELECT graph, name, file, complexity FROM symbols WHERE kind IN ('function', 'method') ORDER BY complexity DESC, graph, name, file LIMIT 20",
    "t1_hotspots": "WITH " + ENTRIES_SQL + """
        SELECT repo_key, name, file, complexity, (end_line - start_line + 1)::INT AS lines FROM entries
        WHERE kind IN ('function', 'method') AND complexity IS NOT NULL AND end_line IS NOT NULL AND start_line IS NOT NULL
        ORDER BY complexity DESC, lines DESC, repo_key, file, name LIMIT 20""",
    "t1_important_symbols": _PR + "SELECT graph, name, file, kind, round(pagerank, 6) AS pagerank FROM ranked JOIN symbols USING (graph, name, file)",
    "t1_explain_architecture": _PR + "SELECT graph, name, file, kind, round(pagerank, 6) AS pagerank, community FROM ranked JOIN symbols USING (graph, name, file) WHERE kind IN ('function', 'method')",
    "w4_structural_rank": _PR + """
        SELECT graph, name, file, place, ceil(100 * place / n)::BIGINT AS top_percent FROM (
          SELECT *, count(*) OVER (PARTITION BY graph ORDER BY round(pagerank, 9) DESC RANGE UNBOUNDED PRECEDING) AS place,
                 count(*) OVER (PARTITION BY graph) AS n FROM ranked)""",
    "g_surprise_candidates": W + """
        SELECT c.graph, c.src, c.src_file, a.community AS src_community, c.dst, c.dst_file, b.community AS dst_community FROM calls c
        JOIN symbols a ON a.graph = c.graph AND a.name = c.src AND a.file = c.src_file
        JOIN symbols b ON b.graph = c.graph AND b.name = c.dst AND b.file = c.dst_file WHERE c.src_file <> c.dst_file""",
    "g_hook_handlers": "WITH " + ROUTES_SQL + "," + HOOKS_SQL + " SELECT symbol, file, method, path FROM hooks WHERE side = 'server'",
    "g_hook_fires": "WITH " + ROUTES_SQL + "," + HOOKS_SQL + " SELECT symbol, file, path FROM hooks WHERE side = 'client'",
    "g_all_hooks": "WITH " + ROUTES_SQL + "," + HOOKS_SQL + " SELECT DISTINCT method, path, side FROM hooks",
    "g1_pagerank": _PR + "SELECT graph, name, file, round(pagerank, 6) AS pagerank FROM ranked",
    "g2_personalized_pagerank": W + ", " + rank_sql("SELECT *, 1.0 AS w FROM calls", _SEEDED) + " SELECT graph, name, file, round(r, 6) AS pagerank FROM pr_20",
    "g3_weighted_pagerank": W + ", " + rank_sql(f"SELECT *, {_LABELS} AS w FROM edges WHERE label <> 'USES'", _SEEDED) + " SELECT graph, name, file, round(r, 6) AS pagerank FROM pr_20",
    "g6_surprise": _PR + _SURPRISE + "SELECT * FROM scores",
    "a5_node_surprise": _PR + _SURPRISE + "SELECT graph, name, file, round(max(score) / 6, 6) AS surprise FROM (SELECT graph, src AS name, src_file AS file, score FROM scores UNION ALL SELECT graph, dst, dst_file, score FROM scores) GROUP BY ALL",
    "g7_top_surprises": _PR + _SURPRISE + "SELECT * FROM scores WHERE score > 0 ORDER BY score DESC, graph, src, src_file, dst, dst_file LIMIT 10",
    "g8_trace": W + trace_sql(5),
    "g8_trace_callers": W + trace_sql(5, END, callers=True),
    "g9_trace_bfs": W + reach_sql(_DOWN, "SELECT * FROM symbols WHERE kind = 'method'", 5) + " SELECT graph, seed, seed_file, name, file, distance FROM reached",
    "g9_trace_bfs_of": W + reach_sql(_DOWN, f"SELECT * FROM symbols WHERE name = '{START}'", 10) + " SELECT graph, seed, seed_file, name, file, distance FROM reached",
    "g10_impact": W + reach_sql("SELECT graph, dst AS a, dst_file AS af, src AS b, src_file AS bf FROM calls", "SELECT graph, dst AS name, dst_file AS file FROM calls", 5) + f"""
        , rolled AS (SELECT r.graph, seed, seed_file, count(*) AS callers, count(DISTINCT {package_sql('r.file')}) AS packages, count(DISTINCT s.community) AS communities,
                round(avg(greatest(0.1, 1 - 0.2 * (distance - 1))), 6) AS confidence, max(distance)::INT AS depth
                FROM reached r LEFT JOIN symbols s ON s.graph = r.graph AND s.name = r.name AND s.file = r.file GROUP BY ALL)
        SELECT graph, seed AS name, seed_file AS file, callers, packages, communities, confidence, depth,
               round(callers * (1 + 0.1 * packages + 0.15 * greatest(communities - 1, 0)), 6) AS risk,
               CASE WHEN callers = 0 THEN 'none' WHEN callers <= 5 AND packages <= 2 THEN 'low' WHEN callers <= 20 AND packages <= 5 THEN 'medium' ELSE 'high' END AS band
        FROM rolled""",
    "g14_seed_expansion": W + """
        SELECT DISTINCT graph, name, file FROM (
          SELECT c.graph, c.dst AS name, c.dst_file AS file FROM calls c JOIN symbols s ON s.graph = c.graph AND s.name = c.src AND s.kind = 'struct'
          UNION ALL SELECT c.graph, c.src, c.src_file FROM calls c JOIN symbols s ON s.graph = c.graph AND s.name = c.dst AND s.kind = 'struct') x
        WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.graph = x.graph AND s.name = x.name AND s.kind = 'struct')""",
}
SQL |= {f"{name}_named": f"SELECT * FROM ({SQL[name]}) WHERE {condition}" for name, (_, _, condition) in NAMED.items()}
SQL |= {
    "g10_impact_of": f"SELECT * FROM ({SQL['g10_impact']}) WHERE name = '{END}'",
    "j1_depends_on_named": W + "," + _IMPORTS + f" SELECT DISTINCT graph, {package_sql('file')} AS src_package, package FROM imports WHERE contains(file, '{FOLDER}')",
    "j2_cross_calls_named": f"SELECT * FROM ({SQL['j2_cross_calls']}) WHERE contains(path, '{ROUTE}')",
    "j3_api_routes_named": f"SELECT * FROM ({SQL['j3_api_routes']}) WHERE contains(path, '{ROUTE}')",
    "a1_most_connected_top": SQL["a1_most_connected"] + " ORDER BY call_count DESC, s.graph, s.name, s.file LIMIT 20",
    "a3_communities_top": SQL["a3_communities"] + " ORDER BY size DESC, graph, community LIMIT 10",
    "a4_hotspot_files_top": _PR + "SELECT graph, file, max(round(pagerank, 6)) AS max_pagerank, count(*) AS symbols FROM ranked GROUP BY ALL ORDER BY max_pagerank DESC, graph, file LIMIT 10",
    "t1_important_symbols_top": _PR + "SELECT graph, name, file, kind, round(pagerank, 6) AS pagerank FROM ranked JOIN symbols USING (graph, name, file) ORDER BY pagerank DESC, graph, name, file LIMIT 15",
}
