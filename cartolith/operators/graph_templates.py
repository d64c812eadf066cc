"""The named graph queries.  Each takes a graph and optional parameters; without them it answers for every node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.sources.tables import Graph, package_of

CALLABLE = ("function", "method")


def _only(df: DataFrame, column: str, value: str | None) -> DataFrame:
    return df if value is None else df.where(F.col(column) == value)


def _containing(df: DataFrame, column: str, text: str | None) -> DataFrame:
    """Case-sensitive; an empty text matches everything, as does none."""
    return df if not text else df.where(F.col(column).contains(text))


def _top(df: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


def who_calls(g: Graph, name: str | None = None) -> DataFrame:
    return _only(g.calls(), "dst", name).select(
        "graph", "dst", "dst_file", F.col("src").alias("caller"), F.col("src_file").alias("caller_file")
    ).distinct()


def calls_of(g: Graph, name: str | None = None) -> DataFrame:
    return _only(g.calls(), "src", name).select(
        "graph", "src", "src_file", F.col("dst").alias("callee"), F.col("dst_file").alias("callee_file")
    ).distinct()


def imports(g: Graph) -> DataFrame:
    """File to foreign package: what a file's symbols use outside their own folder."""
    used = g.edges.select("graph", F.col("src_file").alias("file"), package_of(F.col("dst_file")).alias("package"))
    return used.where(package_of(F.col("file")) != F.col("package")).distinct()


def imports_of(g: Graph, path: str | None = None) -> DataFrame:
    return _containing(imports(g), "file", path)


def importers_of(g: Graph, name: str | None = None) -> DataFrame:
    return _only(imports(g), "package", name).select("graph", "package", "file")


def symbols_in(g: Graph, path: str | None = None) -> DataFrame:
    return _containing(g.symbols, "file", path).select("graph", "file", "name", "kind").distinct()


def depends_on(g: Graph, package: str | None = None) -> DataFrame:
    return _containing(imports(g), "file", package).select(
        "graph", package_of(F.col("file")).alias("src_package"), "package"
    ).distinct()


def dependents_of(g: Graph, name: str | None = None) -> DataFrame:
    return _only(imports(g), "package", name).select("graph", "package", "file").distinct()


def most_connected(g: Graph, limit: int | None = None) -> DataFrame:
    """Symbols by number of call edges that reach them, parallel ones counted."""
    calls = g.calls().groupBy("graph", F.col("dst").alias("name"), F.col("dst_file").alias("file")).agg(
        F.count("*").alias("call_count")
    )
    found = g.symbols.join(calls, ["graph", "name", "file"]).select("graph", "name", "kind", "file", "call_count")
    return _top(found, limit, F.desc("call_count"), "graph", "name", "file")


def dead_code(g: Graph) -> DataFrame:
    """Functions that no call reaches."""
    called = g.calls().select("graph", F.col("dst").alias("name"), F.col("dst_file").alias("file"))
    functions = g.symbols.where(F.col("kind") == "function")
    return functions.join(called, ["graph", "name", "file"], "left_anti").select("graph", "name", "file")


def inherits(g: Graph, name: str | None = None) -> DataFrame:
    up = g.edges.where(F.col("label").isin("INHERITS", "IMPLEMENTS"))
    return _only(up, "src", name).select(
        "graph", F.col("src").alias("child"), F.col("dst").alias("parent"), F.col("dst_file").alias("file"),
        F.col("label").alias("relation"),
    )


def implementations(g: Graph, name: str | None = None) -> DataFrame:
    up = g.edges.where(F.col("label").isin("INHERITS", "IMPLEMENTS"))
    return _only(up, "dst", name).select(
        "graph", F.col("dst").alias("parent"), F.col("src").alias("child"), F.col("src_file").alias("file"),
        F.col("label").alias("relation"),
    )


def type_hierarchy(g: Graph, name: str | None = None) -> DataFrame:
    """Each symbol with its parents and children; two outer joins, so that parents times children come out."""
    up = g.edges.where(F.col("label") == "INHERITS")
    parents = up.select("graph", F.col("src").alias("name"), F.col("src_file").alias("file"), F.col("dst").alias("parent"))
    children = up.select("graph", F.col("dst").alias("name"), F.col("dst_file").alias("file"), F.col("src").alias("child"))
    keys = ["graph", "name", "file"]
    return (
        _only(g.symbols, "name", name).select(*keys).join(parents, keys, "left").join(children, keys, "left")
    )


def complex_symbols(g: Graph, limit: int | None = None) -> DataFrame:
    found = g.symbols.where(F.col("kind").isin(*CALLABLE)).select("graph", "name", "file", "complexity")
    return _top(found, limit, F.desc("complexity"), "graph", "name", "file")


def hotspots(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Functions and methods by complexity, then length, over symbol entries that have both."""
    found = entries.where(F.col("kind").isin(*CALLABLE) & F.col("complexity").isNotNull()).select(
        "repo_key", "name", "file", "complexity", (F.col("end_line") - F.col("start_line") + 1).alias("lines")
    ).where(F.col("lines").isNotNull())
    return _top(found, limit, F.desc("complexity"), F.desc("lines"), "repo_key", "file", "name")


def important_symbols(ranked: DataFrame, symbols: DataFrame, limit: int | None = None) -> DataFrame:
    """Symbols by PageRank; ``ranked``: graph, name, file, pagerank."""
    found = symbols.join(ranked, ["graph", "name", "file"]).select("graph", "name", "file", "kind", "pagerank")
    return _top(found, limit, F.desc("pagerank"), "graph", "name", "file")


def explain_architecture(ranked: DataFrame, symbols: DataFrame, limit: int | None = None) -> DataFrame:
    found = symbols.where(F.col("kind").isin(*CALLABLE)).join(ranked, ["graph", "name", "file"])
    return _top(
        found.select("graph", "name", "file", "kind", "pagerank", "community"), limit, F.desc("pagerank"), "graph", "name", "file"
    )


def hotspot_files(ranked: DataFrame, limit: int | None = None) -> DataFrame:
    found = ranked.groupBy("graph", "file").agg(F.max("pagerank").alias("max_pagerank"), F.count("*").alias("symbols"))
    return _top(found, limit, F.desc("max_pagerank"), "graph", "file")


def communities(g: Graph, limit: int | None = None) -> DataFrame:
    """Communities with their size and the sorted names of their members."""
    found = g.symbols.where(F.col("community").isNotNull()).groupBy("graph", "community").agg(
        F.count("*").alias("size"), F.array_sort(F.collect_list("name")).alias("members")
    )
    return _top(found, limit, F.desc("size"), "graph", "community")


def community_members(g: Graph, community: int | None = None) -> DataFrame:
    found = g.symbols if community is None else g.symbols.where(F.col("community") == community)
    return found.select("graph", "community", "name", "kind", "file")


def layers(g: Graph) -> DataFrame:
    """File to layer, named by the first folder of its path."""
    return g.symbols.select("graph", "file", F.substring_index("file", "/", 1).alias("layer")).distinct()


def layer_deps(g: Graph) -> DataFrame:
    """Calls between layers, counted."""
    at = layers(g)
    joined = (
        g.calls()
        .join(at.select("graph", F.col("file").alias("src_file"), F.col("layer").alias("from_layer")), ["graph", "src_file"])
        .join(at.select("graph", F.col("file").alias("dst_file"), F.col("layer").alias("to_layer")), ["graph", "dst_file"])
    )
    return joined.where(F.col("from_layer") != F.col("to_layer")).groupBy("graph", "from_layer", "to_layer").agg(
        F.count("*").alias("connections")
    )


def api_routes(routes: DataFrame, path: str | None = None) -> DataFrame:
    """``symbol, file, relation, method, path`` of routes (symbol, file, method, path, side, framework)."""
    relation = F.when(F.col("side") == "server", "HANDLES").otherwise("FETCHES")
    return _containing(routes, "path", path).select("symbol", "file", relation.alias("relation"), "method", "path").distinct()


def cross_calls(routes: DataFrame, path: str | None = None) -> DataFrame:
    """Handlers and callers of a route that meet in method and path."""
    own = _containing(routes, "path", path)
    server = own.where(F.col("side") == "server").select(
        "method", "path", F.col("symbol").alias("server"), F.col("file").alias("server_file")
    ).distinct()
    client = own.where(F.col("side") == "client").select(
        "method", "path", F.col("symbol").alias("client"), F.col("file").alias("client_file")
    ).distinct()
    return server.join(client, ["method", "path"])


def polyglot_overview(layer_files: DataFrame, routes: DataFrame) -> DataFrame:
    """Files and handled routes per layer; ``layer_files``: layer, role, language, file."""
    handled = routes.where(F.col("side") == "server").select("file", F.struct("method", "path").alias("route"))
    return layer_files.join(handled, "file", "left").groupBy("layer", "role", "language").agg(
        F.count_distinct("file").alias("files"), F.count_distinct("route").alias("routes")
    )


def hook_handlers(routes: DataFrame, name: str | None = None) -> DataFrame:
    own = routes.where((F.col("framework") == "wordpress") & (F.col("side") == "server"))
    return _only(own, "path", name).select("symbol", "file", "method", "path")


def hook_fires(routes: DataFrame, name: str | None = None) -> DataFrame:
    own = routes.where((F.col("framework") == "wordpress") & (F.col("side") == "client"))
    return _only(own, "path", name).select("symbol", "file", "path")


def all_hooks(routes: DataFrame) -> DataFrame:
    return routes.where(F.col("framework") == "wordpress").select("method", "path", "side").distinct()


def surprise_candidates(g: Graph, limit: int | None = None) -> DataFrame:
    """Calls between files with both ends' communities."""
    left = g.symbols.select("graph", F.col("name").alias("src"), F.col("file").alias("src_file"), F.col("community").alias("src_community"))
    right = g.symbols.select("graph", F.col("name").alias("dst"), F.col("file").alias("dst_file"), F.col("community").alias("dst_community"))
    found = (
        g.calls().where(F.col("src_file") != F.col("dst_file"))
        .join(left, ["graph", "src", "src_file"]).join(right, ["graph", "dst", "dst_file"])
        .select("graph", "src", "src_file", "src_community", "dst", "dst_file", "dst_community")
    )
    return _top(found, limit, "graph", "src", "src_file", "dst", "dst_file")


def structural_rank(ranked: DataFrame) -> DataFrame:
    """``place`` (symbols with at least this PageRank) and ``top_percent`` of each symbol in its graph."""
    peers = Window.partitionBy("graph").orderBy(F.desc("pagerank")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = ranked.groupBy("graph").agg(F.count("*").alias("n"))
    return ranked.withColumn("place", F.count("*").over(peers)).join(sizes, "graph").select(
        "graph", "name", "file", "place", F.ceil(100 * F.col("place") / F.col("n")).cast("bigint").alias("top_percent")
    )
