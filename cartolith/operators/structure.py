"""Imports, layers, cycles, types, hooks and hidden uses: what the code's structure says beyond its calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.operators.quality import nearest_homes
from cartolith.session import broadcast_if_bounded, cut_lineage
from cartolith.sources.tables import package_of

#: Endings that an import may leave out.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".svelte", ".vue", ".py", ".rs", "/index.ts", "/index.js", "/__init__.py", "/mod.rs")


def _joined(folder: Column, target: Column) -> Column:
    """A relative path from a folder, with ``.`` and ``..`` worked out."""
    parts = F.filter(F.split(F.concat_ws("/", F.when(folder != ".", folder), target), "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    walked = F.aggregate(parts, empty, lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.array_join(walked, "/")


def resolved_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """``repo, file, target, resolved, how``: the file that each import (repo, file, target) means, if it is the repository's own.

    ``aliases``: repo, prefix, root (such as ``$lib`` for ``src/lib`` or a
    workspace's name for its folder).  The first rule decides: ``virtual:``
    has no file, an alias stands for its root, a leading dot is relative to the
    importing file, anything else is a folder of the repository.  Endings and
    index files may be left out; the first in the order of ``ENDINGS`` counts.
    """
    rows = imports.select("repo", "file", "target").distinct()
    words = F.filter(F.split("target", "/"), lambda p: p != "")
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words))), lambda n: F.array_join(F.slice(words, 1, n), "/"))
    met = rows.select("repo", "file", "target", F.explode(starts).alias("prefix")).join(broadcast_if_bounded(cut_lineage(aliases, "aliases")), ["repo", "prefix"])
    best = met.groupBy("repo", "file", "target").agg(F.max_by(F.struct("prefix", "root"), F.struct(F.length("prefix"), "prefix")).alias("alias"))
    rows = rows.join(best, ["repo", "file", "target"], "left")
    how = (
        F.when(F.startswith("target", F.lit("virtual:")), "virtual").when(F.col("alias").isNotNull(), "alias")
        .when(F.startswith("target", F.lit(".")), "relative").otherwise("package")
    )
    tail = F.expr("substring(target, length(alias.prefix) + 1)")
    base = (
        F.when(how == "alias", _joined(F.col("alias.root"), tail)).when(how == "relative", _joined(package_of(F.col("file")), F.col("target")))
        .when(how == "package", F.regexp_replace("target", r"::|(?<=\w)\.(?=\w)", "/"))
    )
    options = F.posexplode(F.array(*[F.lit(e) for e in ENDINGS])).alias("o", "ending")
    asked = rows.select("repo", "file", "target", how.alias("how"), base.alias("base"), options)
    asked = asked.select("repo", "file", "target", "how", "o", F.concat("base", "ending").alias("resolved"))
    there = asked.join(files.select("repo", F.col("path").alias("resolved")).distinct(), ["repo", "resolved"])
    first = there.groupBy("repo", "file", "target").agg(F.min_by("resolved", "o").alias("resolved"))
    return rows.select("repo", "file", "target", how.alias("how")).join(first, ["repo", "file", "target"], "left")


def imported_by(resolved: DataFrame) -> DataFrame:
    """``repo, file, packages``: of each file the number of packages that import something of its package."""
    used = resolved.where("resolved IS NOT NULL").select("repo", package_of(F.col("file")).alias("importer"), package_of(F.col("resolved")).alias("package"))
    counts = used.where("importer <> package").distinct().groupBy("repo", "package").agg(F.count("*").alias("packages"))
    own = resolved.where("resolved IS NOT NULL").select("repo", F.col("resolved").alias("file"), package_of(F.col("resolved")).alias("package")).distinct()
    return own.join(counts, ["repo", "package"], "left").select("repo", "file", F.coalesce("packages", F.lit(0)).alias("packages"))


def type_edges(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """``repo, src, src_file, dst, dst_file, label``: type relations (repo, subject, target, kind, file) with the type that the target's name means.

    Of several types of the name the nearest one.  Extending and embedding inherit.
    """
    homes = symbols.select("repo", "name", F.col("file").alias("home"))
    label = F.when(F.col("kind") == "implements", "IMPLEMENTS").otherwise("INHERITS")
    found = nearest_homes(relations.select("repo", F.col("target").alias("name"), "file"), homes)
    edges = relations.select("repo", F.col("subject").alias("src"), "file", F.col("target").alias("name"), label.alias("label")).distinct()
    return edges.join(found, ["repo", "name", "file"]).select(
        "repo", "src", F.col("file").alias("src_file"), F.col("name").alias("dst"), "label", F.col("home").alias("dst_file")
    )


def package_cycles(imports: DataFrame, most: int = 4) -> DataFrame:
    """``graph, cycle``: cycles of 2 to ``most`` packages in edges (graph, src, dst), each once, from its smallest package on.

    Only packages that can come back to themselves take part; a path never
    goes below the package it began with, so that each cycle has one beginning.
    """
    step = cut_lineage(imports.select("graph", "src", "dst").where("src <> dst").distinct(), "cycle-steps")
    current = step.where("dst > src").select("graph", F.col("src").alias("first"), F.col("dst").alias("at"), F.array("src", "dst").alias("path"))
    found = []
    for k in range(2, most + 1):
        closing = current.join(step.select("graph", F.col("src").alias("at"), F.col("dst").alias("first")), ["graph", "at", "first"], "left_semi")
        found.append(closing.select("graph", F.array_join("path", " > ").alias("cycle")))
        if k < most:
            onward = step.select("graph", F.col("src").alias("at"), F.col("dst").alias("next"))
            current = current.join(onward, ["graph", "at"]).where((F.col("next") > F.col("first")) & ~F.array_contains("path", F.col("next")))
            current = cut_lineage(current.select("graph", "first", F.col("next").alias("at"), F.array_append("path", F.col("next")).alias("path")), "cycle-paths")
    return reduce(DataFrame.unionByName, found)


def has_cycle(edges: DataFrame) -> DataFrame:
    """``graph, cyclic``: whether the edges (graph, src, dst) of each graph come back to where they began.

    Nodes without edges into them, or out of them, are taken away until none is
    left or none goes: what remains is cyclic.
    """
    left = cut_lineage(edges.select("graph", "src", "dst").distinct(), "cycle-edges")
    graphs = left.select("graph").distinct()
    n = left.count()
    while n:
        inner = left.join(left.select("graph", F.col("dst").alias("src")), ["graph", "src"], "left_semi")
        inner = cut_lineage(inner.join(left.select("graph", F.col("src").alias("dst")), ["graph", "dst"], "left_semi"), "cycle-edges")
        m = inner.count()
        left = inner
        if m == n:
            break
        n = m
    return graphs.join(left.select("graph").distinct().withColumn("cyclic", F.lit(True)), "graph", "left").select("graph", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def focused_packages(edges: DataFrame, focus: str, depth: int = 2) -> DataFrame:
    """Edges (graph, src, dst) that can be walked within ``depth`` steps from packages whose name holds ``focus``."""
    front = edges.where(F.col("src").contains(focus)).select("graph", "src").distinct()
    seen, kept = front, []
    for k in range(depth):
        out = cut_lineage(edges.join(front, ["graph", "src"]).select("graph", "src", "dst").distinct(), "focus")
        kept.append(out)
        if k + 1 < depth:
            front = out.select("graph", F.col("dst").alias("src")).distinct().join(seen, ["graph", "src"], "left_anti")
            seen = seen.unionByName(front)
    return reduce(DataFrame.unionByName, kept).distinct()


def community_overview(members: DataFrame, least: int = 3, most: int = 10, names: int = 5) -> DataFrame:
    """``graph, community, size, names``: the largest communities (graph, name, file, detected) with their first names."""
    order = Window.partitionBy("graph", "detected").orderBy("name", "file")
    own = members.withColumn("_at", F.row_number().over(order))
    rolled = own.groupBy("graph", F.col("detected").alias("community")).agg(
        F.count("*").alias("size"), F.array_sort(F.collect_list(F.when(F.col("_at") <= names, F.struct("_at", "name")))).alias("n")
    ).where(F.col("size") >= least)
    best = Window.partitionBy("graph").orderBy(F.desc("size"), "community")
    return rolled.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= most).select(
        "graph", "community", "size", F.array_join(F.transform("n", lambda x: x["name"]), ",").alias("names")
    )


def graph_flags(symbols: DataFrame, moved: DataFrame, surprise: DataFrame, least: float = 0.5) -> DataFrame:
    """``graph, name, file, flag``: symbols that changed their community, or whose surprise is ``least`` or more."""
    keys = ["graph", "name", "file"]
    moves = symbols.join(moved.select(*keys), keys, "left_semi").select(*keys, F.lit("community_move").alias("flag"))
    high = symbols.join(surprise.where(F.col("surprise") >= least).select(*keys), keys, "left_semi").select(*keys, F.lit("high_surprise").alias("flag"))
    return moves.unionByName(high).distinct()


def new_insights(scored: DataFrame, known: DataFrame, least: float, flag: str) -> DataFrame:
    """``name, file, flag``: both ends of edges (src, src_file, dst, dst_file, score) of at least ``least`` that are not known (name, file, flag) yet."""
    high = scored.where(F.col("score") >= least)
    ends = high.select(F.col("src").alias("name"), F.col("src_file").alias("file")).unionByName(high.select(F.col("dst").alias("name"), F.col("dst_file").alias("file")))
    return ends.distinct().withColumn("flag", F.lit(flag)).join(known, ["name", "file", "flag"], "left_anti")


def god_packages(edges: DataFrame, least: int = 5, most: int = 50) -> DataFrame:
    """``graph, package, importers``: packages that at least ``least`` others import (graph, src, dst), the most imported of each graph."""
    counts = edges.where("src <> dst").groupBy("graph", F.col("dst").alias("package")).agg(F.count_distinct("src").alias("importers")).where(F.col("importers") >= least)
    order = Window.partitionBy("graph").orderBy(F.desc("importers"), "package")
    return counts.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most).drop("_at")


def abstraction(symbols: DataFrame) -> DataFrame:
    """``graph, interfaces, interface_ratio, communities``: interfaces, their share of interfaces and structs, and distinct communities."""
    interfaces, structs = F.count_if(F.col("kind") == "interface"), F.count_if(F.col("kind") == "struct")
    return symbols.groupBy("graph").agg(
        interfaces.alias("interfaces"),
        F.round(F.coalesce(interfaces / F.nullif(interfaces + structs, F.lit(0)), F.lit(0.0)), 6).alias("interface_ratio"),
        F.count_distinct("community").alias("communities"),
    )


def roots_and_leaves(edges: DataFrame) -> DataFrame:
    """``graph, package, place``: packages that none imports (``root``) or that import none (``leaf``)."""
    out = edges.select("graph", F.col("src").alias("package")).distinct()
    into = edges.select("graph", F.col("dst").alias("package")).distinct()
    roots = out.join(into, ["graph", "package"], "left_anti").withColumn("place", F.lit("root"))
    return roots.unionByName(into.join(out, ["graph", "package"], "left_anti").withColumn("place", F.lit("leaf")))


def hook_edges(fires: DataFrame, handlers: DataFrame, symbols: DataFrame) -> DataFrame:
    """``repo, hook, caller, callee, callee_file``: callbacks of each hook as calls without a caller.

    ``fires``: repo, hook; ``handlers``: repo, hook, callback; every symbol
    (repo, name, file) of a callback's name is a target; a hook that is only
    registered gives an edge too.
    """
    known = fires.select("repo", "hook").unionByName(handlers.select("repo", "hook")).distinct()
    met = known.join(handlers.select("repo", "hook", "callback").distinct(), ["repo", "hook"])
    homes = symbols.select("repo", F.col("name").alias("callback"), F.col("file").alias("callee_file")).distinct()
    return met.join(homes, ["repo", "callback"]).select("repo", "hook", F.lit(None).cast("string").alias("caller"), F.col("callback").alias("callee"), "callee_file")


def merged_calls(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Edges of several call graphs, of each key the one of the first graph that has it."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(n)) for n, p in enumerate(parts)])
    rest = [c for c in rows.columns if c not in (*keys, "_part")]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(F.lit(0).alias("_"), *rest), F.struct("_part", *rest)).alias("v")).select(*keys, *[f"v.{c}" for c in rest])


def without_standard(calls: DataFrame, names: list[str]) -> DataFrame:
    """Calls whose callee is found, or is no function of the standard library."""
    return calls.where(F.col("callee_file").isNotNull() | ~F.col("callee").isin(*names))


def template_users(uses: DataFrame, name: str) -> DataFrame:
    """``graph, name, file, distance``: who uses a component (edges labelled USES), as the impact of something that is no function."""
    return uses.where((F.col("label") == "USES") & (F.col("dst") == name)).select("graph", F.col("src").alias("name"), F.col("src_file").alias("file"), F.lit(1).alias("distance")).distinct()


def hidden_callers(bodies: DataFrame, names: DataFrame) -> DataFrame:
    """``target, repo, file, caller, confidence``: bodies (repo, file, name, body) that mention a name (repo, target): 0.6 as a word, 0.4 in quotes only.

    Names are joined to the words of the bodies, each body's distinct words
    once; the best mention of a file and caller holds, and known callers are kept.
    """
    own = bodies.where("body IS NOT NULL").select("repo", "file", F.col("name").alias("caller"), "body")
    plain = F.regexp_replace("body", r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'", " ")
    word = F.lit(r"[A-Za-z_]\w*")
    mentioned = own.select("repo", "file", "caller", F.explode(F.array_distinct(F.regexp_extract_all(plain, word, F.lit(0)))).alias("target"), F.lit(0.6).alias("confidence"))
    quoted = own.select("repo", "file", "caller", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"[\"']([A-Za-z_]\w*)[\"']"), F.lit(1)))).alias("target"), F.lit(0.4).alias("confidence"))
    met = mentioned.unionByName(quoted).join(names.select("repo", "target").distinct(), ["repo", "target"]).where("caller <> target")
    return met.groupBy("target", "repo", "file", "caller").agg(F.max("confidence").alias("confidence"))


def without_string_uses(candidates: DataFrame, bodies: DataFrame, most: int | None = 50) -> DataFrame:
    """Dead-code candidates (repo, name) whose name no other body (repo, name, body) mentions; only the first ``most`` are looked at, the rest stay."""
    asked = candidates if most is None else candidates.orderBy("repo", "name").limit(most)
    used = hidden_callers(bodies.withColumn("file", F.lit("")), asked.select("repo", F.col("name").alias("target"))).select("repo", F.col("target").alias("name")).distinct()
    return candidates.join(used, ["repo", "name"], "left_anti")


def upstream_walk(hypotheses: DataFrame, calls: DataFrame, backward: bool, top: int, depth: int, most: int = 9) -> DataFrame:
    """``investigation_id, name, distance, score``: up to ``most`` functions that call (``backward``) or are called by an investigation's best ``top`` suspects.

    ``hypotheses``: investigation_id, subject, place; ``calls``: src, dst by
    name.  The score is 0.3 over the distance.
    """
    a, b = ("dst", "src") if backward else ("src", "dst")
    step = calls.select(F.col(a).alias("name"), F.col(b).alias("next")).distinct()
    front = hypotheses.where(F.col("place") <= top).select("investigation_id", F.col("subject").alias("name")).distinct()
    known, found = front, []
    for k in range(1, depth + 1):
        new = front.join(step, "name").select("investigation_id", F.col("next").alias("name")).distinct()
        front = cut_lineage(new.join(known, ["investigation_id", "name"], "left_anti"), "walk")
        found.append(front.withColumn("distance", F.lit(k)))
        known = known.unionByName(front)
    order = Window.partitionBy("investigation_id").orderBy("distance", "name")
    rows = reduce(DataFrame.unionByName, found).withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most)
    return rows.select("investigation_id", "name", "distance", F.round(0.3 / F.col("distance"), 6).alias("score"))


def version_change(current: Column, latest: Column) -> Column:
    """``current``, ``major``, ``minor``, ``patch`` or ``unknown``: how far a version is behind; a leading v and suffixes are passed over."""
    def part(v: Column, k: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(v, r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?", k), F.lit("")).cast("bigint"), F.lit(0))

    valid = current.rlike(r"^v?\d+") & latest.rlike(r"^v?\d+")
    behind = F.lit("current")
    for k, name in ((3, "patch"), (2, "minor"), (1, "major")):
        behind = F.when(part(latest, k) > part(current, k), name).when(part(latest, k) < part(current, k), "current").otherwise(behind)
    return F.when(valid, behind).otherwise("unknown")


def freshness(dependencies: DataFrame, latest: DataFrame, vulnerable: DataFrame) -> DataFrame:
    """Per repository: dependencies, those at each distance from the latest version, shares that are fresh and that have no known weakness.

    ``dependencies``: repo, ecosystem, name, version; ``latest``: ecosystem,
    name, latest; ``vulnerable``: ecosystem, name, version.
    """
    joined = dependencies.join(latest, ["ecosystem", "name"], "left").join(
        vulnerable.select("ecosystem", "name", "version").distinct().withColumn("_weak", F.lit(True)), ["ecosystem", "name", "version"], "left"
    ).withColumn("change", version_change(F.col("version"), F.col("latest")))
    known = F.count_if(~F.coalesce(F.col("change"), F.lit("unknown")).isin("unknown"))
    return joined.groupBy("repo").agg(
        F.count("*").alias("total_deps"), *[F.count_if(F.col("change") == c).alias(c) for c in ("major", "minor", "patch")],
        F.round(F.coalesce(F.count_if(F.col("change") == "current") / F.nullif(known, F.lit(0)), F.lit(0.0)), 6).alias("fresh_ratio"),
        F.round(1 - F.count_if(F.col("_weak").isNotNull()) / F.count("*"), 6).alias("secure_ratio"),
    )
