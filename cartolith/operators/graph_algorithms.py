"""Ranking, traversal and community algorithms over many graphs at once, as rounds of joins and aggregates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions.predicates import is_exported, language_of
from cartolith.session import broadcast_if_bounded, cut_lineage, ship_package
from cartolith.sources.tables import Graph, package_of

NODE = ["graph", "name", "file"]
#: Rounds after which lineage is cut.
CUT_EVERY = 5
#: Edges from which the paths of each length are staged.
LONG_PATH = 4
#: Nodes and edges up to which a graph fits into one task (some 100 bytes each).
SMALL_GRAPH = 500_000


def numbered_nodes(nodes: DataFrame) -> DataFrame:
    """The rows of ``nodes`` (graph, name, file and more, no node twice) with a number ``id``, written once so that numbers hold."""
    return cut_lineage(nodes.withColumn("id", F.monotonically_increasing_id()), "numbered-nodes")


def numbered_edges(numbered: DataFrame, edges: DataFrame, how: str = "inner") -> DataFrame:
    """Edges with the numbers ``a`` and ``b`` of their ends; ``how`` says what becomes of edges to unknown nodes."""

    def end(name: str, file: str, alias: str) -> DataFrame:
        return numbered.select("graph", F.col("name").alias(name), F.col("file").alias(file), F.col("id").alias(alias))

    return edges.join(end("src", "src_file", "a"), ["graph", "src", "src_file"]).join(
        end("dst", "dst_file", "b"), ["graph", "dst", "dst_file"], how
    )


def graph_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph, size``: nodes and edges of each graph, staged."""
    both = nodes.select("graph").unionByName(edges.select("graph"))
    return cut_lineage(both.groupBy("graph").agg(F.count("*").alias("size")), "graph-sizes")


def _bucket(sizes: DataFrame, small: int) -> Column:
    """A number that many graphs of up to ``small`` nodes and edges share, so that each number holds some ``small`` of them at most."""
    total = sizes.where(F.col("size") <= small).agg(F.sum("size")).first()[0] or 0
    return F.pmod(F.xxhash64("graph"), F.lit(max(32, 4 * total // max(1, small)))).cast("int").alias("bucket")


def pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    seeds: DataFrame | None = None,
    weight: str | None = None,
    damping: float = 0.85,
    rounds: int = 20,
    small: int = SMALL_GRAPH,
) -> DataFrame:
    """``graph, name, file, pagerank`` after a fixed number of synchronous rounds.

    Without ``seeds`` rank starts and teleports uniformly and that of nodes
    without out-edges is spread over all.  With ``seeds`` (graph, name, file,
    seed) it starts uniformly, but teleport and dangling rank go to the seeds
    in proportion; seeds outside the graph still count in the total, so that
    mass may be less than 1.  ``weight`` names an edge weight; parallel edges
    count each.

    Graphs of up to ``small`` nodes and edges are dealt to tasks whole; the
    rounds of larger ones are joins (``pagerank_by_joins``).  Both give the
    same ranks.
    """
    sizes = graph_sizes(nodes, edges)
    bucket = _bucket(sizes, small)
    if sizes.where(F.col("size") > small).isEmpty():
        return pagerank_in_tasks(nodes, edges, bucket, seeds, weight, damping, rounds)
    little, large = (broadcast_if_bounded(sizes.where(c).select("graph")) for c in (F.col("size") <= small, F.col("size") > small))

    def only(rows: DataFrame | None, own: DataFrame) -> DataFrame | None:
        return None if rows is None else rows.join(own, "graph", "left_semi")

    one = pagerank_in_tasks(only(nodes, little), only(edges, little), bucket, only(seeds, little), weight, damping, rounds)
    return one.unionByName(pagerank_by_joins(only(nodes, large), only(edges, large), only(seeds, large), weight, damping, rounds))


def pagerank_in_tasks(
    nodes: DataFrame, edges: DataFrame, bucket: Column, seeds: DataFrame | None, weight: str | None, damping: float, rounds: int
) -> DataFrame:
    """``pagerank`` with the graphs of a bucket in one task: one exchange, and vector arithmetic over all of them at once."""
    ship_package(nodes.sparkSession)
    seeded = seeds is not None
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    links = edges.select("graph", F.col("src").alias("name"), F.col("src_file").alias("file"), "dst", "dst_file", w.alias("w"))
    rows = nodes.select(*NODE, F.lit(False).alias("seeded"), F.lit(0.0).alias("seed")).unionByName(links, allowMissingColumns=True)
    if seeds is not None:
        rows = rows.unionByName(seeds.select(*NODE, "seed", F.lit(True).alias("seeded")), allowMissingColumns=True)

    def key(rows: pd.DataFrame, name: str, file: str) -> pd.Series:
        return rows["graph"].astype(str).str.cat([rows[name], rows[file]], sep="\0")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own, given, calls = group[group["seeded"].eq(False)], group[group["seeded"].eq(True)], group[group["w"].notna()]
        n = len(own)
        graphs, at = np.unique(own["graph"].to_numpy(), return_inverse=True)
        index = pd.Index(key(own, "name", "file"))
        a, b = index.get_indexer(key(calls, "name", "file")), index.get_indexer(key(calls, "dst", "dst_file"))
        known = a >= 0
        a, b, w = a[known], b[known], calls["w"].to_numpy(float)[known]
        out = np.bincount(a, w, minlength=n)
        dangling = np.bincount(a, minlength=n) == 0
        rank = jump = 1 / np.bincount(at)[at] if n else np.zeros(0)
        if seeded:
            totals = given.groupby("graph")["seed"].sum().reindex(graphs).to_numpy(float)
            to, seed = index.get_indexer(key(given, "name", "file")), given["seed"].to_numpy(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                jump = np.nan_to_num(np.bincount(to[to >= 0], seed[to >= 0], minlength=n) / totals[at], posinf=0.0)
        inside = b >= 0
        a, b, share = a[inside], b[inside], (damping * w / out[a])[inside]
        for _ in range(rounds):
            lost = np.bincount(at[dangling], rank[dangling], minlength=len(graphs))
            rank = np.bincount(b, rank[a] * share, minlength=n) + (1 - damping + damping * lost)[at] * jump
        return own[NODE].assign(pagerank=rank)

    return rows.groupBy(bucket).applyInPandas(run, "graph bigint, name string, file string, pagerank double")


def pagerank_by_joins(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None, weight: str | None, damping: float, rounds: int
) -> DataFrame:
    """``pagerank`` of graphs of any size.

    Nodes are numbered once.  A round is linear in the rank, so that it is
    enough to send the teleport vector (and the start, where it differs) along
    the edges ``rounds`` times and to keep every step as a column; what the
    dangling nodes lose follows afterwards from one aggregate a graph, and the
    rank is a weighted sum of the steps.  A round is one join along the edges
    and one aggregate by number, combined before its exchange.
    """
    numbered = numbered_nodes(nodes.select(*NODE))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    summed = edges.groupBy("graph", "src", "src_file", "dst", "dst_file").agg(F.sum(w).alias("w"))
    out = F.sum("w").over(Window.partitionBy("a"))
    shares = numbered_edges(numbered, summed, "left").select("a", "b", (damping * F.col("w") / out).alias("share"))
    shares = cut_lineage(shares, "rank-shares")
    sizes = numbered.groupBy("graph").agg(F.count("*").cast("double").alias("n"))
    base = numbered.join(sizes, "graph")
    if seeds is None:
        chains, base = ["v"], base.withColumn("v0", 1 / F.col("n"))
    else:
        totals = seeds.groupBy("graph").agg(F.sum("seed").alias("_total"))
        chains, base = ["v", "u"], base.join(seeds, NODE, "left").join(totals, "graph", "left").withColumns(
            {"v0": F.coalesce(F.col("seed") / F.col("_total"), F.lit(0.0)), "u0": 1 / F.col("n")}
        )
    state = cut_lineage(base.select("id", *[f"{c}0" for c in chains]), "rank-state")
    linked = broadcast_if_bounded(shares.where("b IS NOT NULL"))
    for k in range(1, rounds + 1):
        sent = state.join(linked, F.col("id") == F.col("a")).select(
            F.col("b").alias("id"), *[(F.col(f"{c}{k - 1}") * F.col("share")).alias(c) for c in chains]
        )
        before = [f"{c}{j}" for c in chains for j in range(k)]
        kept = state.select("id", *before, *[F.lit(0.0).alias(f"{c}{k}") for c in chains])
        new = sent.select("id", *[F.lit(0.0).alias(c) for c in before], *[F.col(c).alias(f"{c}{k}") for c in chains])
        state = kept.unionByName(new).groupBy("id").agg(*[F.sum(c).alias(c) for c in new.columns[1:]])
        if k % CUT_EVERY == 0 or k == rounds:
            state = cut_lineage(state, "rank-state")

    dangling = state.join(shares.select(F.col("a").alias("id")).distinct(), "id", "left_anti").join(numbered, "id")
    lost = dangling.groupBy("graph").agg(*[F.sum(f"{c}{j}").alias(f"{c}{j}") for c in chains for j in range(rounds)])
    lost = sizes.select("graph").join(lost, "graph", "left")

    def losses(chain: str) -> Column:
        return F.array(*[F.coalesce(f"{chain}{j}", F.lit(0.0)) for j in range(rounds)])

    def jump(before: Column, k: Column) -> Column:
        parts = F.zip_with(before, F.reverse(F.slice("_v", 1, k)), lambda s, v: s * v)
        mass = F.get("_u", k) + F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
        return F.array_append(before, 1 - damping + damping * mass)

    steps = F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.array().cast("array<double>"), jump)
    factors = lost.select("graph", losses("v").alias("_v"), losses(chains[-1]).alias("_u")).select("graph", steps.alias("_s"))
    rank = reduce(
        lambda x, y: x + y, [F.get("_s", F.lit(i)) * F.col(f"v{rounds - 1 - i}") for i in range(rounds)], F.col(f"{chains[-1]}{rounds}")
    )
    return state.join(numbered, "id").join(broadcast_if_bounded(cut_lineage(factors, "rank-factors")), "graph").select(
        *NODE, rank.alias("pagerank")
    )


def _nodes_of(edges: DataFrame, *more: DataFrame) -> DataFrame:
    ends = [
        edges.select("graph", F.col("src").alias("name"), F.col("src_file").alias("file")),
        edges.select("graph", F.col("dst").alias("name"), F.col("dst_file").alias("file")),
        *[m.select(*NODE) for m in more],
    ]
    return numbered_nodes(reduce(DataFrame.unionByName, ends).distinct())


def reach_ids(step: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``seed, node, distance``: nodes within ``depth`` steps (a, b) of each seed (id), at their least distance.

    A seed itself is not among them.  Each round joins the new frontier to the
    steps and drops what was reached before, so that a cycle ends.  Nodes are
    numbers; every frontier is staged and read twice.
    """
    known = frontier = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("distance")).distinct()
    for k in range(1, depth + 1):
        found = frontier.join(step, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct()
        frontier = cut_lineage(
            found.join(known, ["seed", "node"], "left_anti").withColumn("distance", F.lit(k)), "frontier"
        )
        known = known.unionByName(frontier)
        if frontier.isEmpty():
            break
    return known.where(F.col("distance") > 0)


def _steps(numbered: DataFrame, edges: DataFrame, backward: bool = False) -> DataFrame:
    pairs = numbered_edges(numbered, edges.select("graph", "src", "src_file", "dst", "dst_file"))
    ends = ("b", "a") if backward else ("a", "b")
    return cut_lineage(pairs.select(F.col(ends[0]).alias("a"), F.col(ends[1]).alias("b")).distinct(), "steps")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, backward: bool = False) -> DataFrame:
    """``graph, seed, seed_file, name, file, distance``: nodes within ``depth`` edges of each seed (graph, name, file).

    The result grows with the number of seeds times what each reaches; name the
    seeds that are asked for.
    """
    numbered = _nodes_of(edges, seeds)
    ids = seeds.select(*NODE).distinct().join(numbered, NODE).select("id")
    found = reach_ids(_steps(numbered, edges, backward), ids, depth)
    origin = numbered.select("graph", F.col("name").alias("seed_name"), F.col("file").alias("seed_file"), F.col("id").alias("seed"))
    target = numbered.select(F.col("id").alias("node"), "name", "file")
    return found.join(origin, "seed").join(target, "node").select(
        "graph", F.col("seed_name").alias("seed"), "seed_file", "name", "file", "distance"
    )


def paths(edges: DataFrame, depth: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """``graph, src, src_file, dst, dst_file, hops``: pairs joined by a path of 1 to ``depth`` edges, with each length.

    No edge is used twice in a path; a pair comes out once for each length.
    ``start`` and ``end`` name the first and the last node: paths grow from
    ``start`` alone, and only over nodes from which ``end`` can be reached.
    Nodes and edges are numbers.  Paths of ``LONG_PATH`` edges and more are
    staged, and of those that join the same pair over the same edges one goes
    on, as all have the same continuations.
    """
    numbered = _nodes_of(edges)
    step = _steps(numbered, edges)
    step = cut_lineage(step.withColumn("edge", F.monotonically_increasing_id()), "path-steps")
    if end is not None:
        goal = numbered.where(F.col("name") == end).select("id")
        near = reach_ids(step.select(F.col("b").alias("a"), F.col("a").alias("b")), goal, depth - 1).select(F.col("node").alias("b"))
        useful = cut_lineage(near.unionByName(goal.withColumnRenamed("id", "b")).distinct(), "path-useful")
        step = cut_lineage(step.join(useful, "b", "left_semi"), "path-steps")
    first = step
    if start is not None:
        first = step.join(numbered.where(F.col("name") == start).select(F.col("id").alias("a")), "a", "left_semi")
    current = first.select(F.col("a").alias("from"), F.col("b").alias("to"), F.array("edge").alias("used"))
    result = [current.select("from", "to", F.lit(1).alias("hops"))]
    for k in range(2, depth + 1):
        current = (
            current.join(step, F.col("to") == F.col("a"))
            .where(~F.array_contains("used", F.col("edge")))
            .select("from", F.col("b").alias("to"), F.array_append("used", F.col("edge")).alias("used"))
        )
        if k >= LONG_PATH:
            current = cut_lineage(current.withColumn("used", F.array_sort("used")).distinct(), "paths")
        result.append(current.select("from", "to", F.lit(k).alias("hops")))
    found = reduce(DataFrame.unionByName, [r.distinct() for r in result])
    source = numbered.select("graph", F.col("name").alias("src"), F.col("file").alias("src_file"), F.col("id").alias("from"))
    target = numbered.select(F.col("name").alias("dst"), F.col("file").alias("dst_file"), F.col("id").alias("to"))
    if end is not None:
        target = target.where(F.col("dst") == end)
    return found.join(source, "from").join(target, "to").select("graph", "src", "src_file", "dst", "dst_file", "hops")


def longest_chain(edges: DataFrame, depth: int = 10, large: int = 8000, large_depth: int = 6) -> DataFrame:
    """``graph, call_depth``: the greatest length up to ``depth`` of a path in which no edge is used twice.

    Graphs of more than ``large`` edges are looked at up to ``large_depth``.
    Where the longest walk is shorter than that there is no cycle, and it is
    the answer; walks are followed as sets of nodes.  Only graphs with longer
    walks have their paths followed edge by edge, of equal ends and edges one.
    """
    numbered = _nodes_of(edges)
    pairs = numbered_edges(numbered, edges.select("graph", "src", "src_file", "dst", "dst_file")).select("graph", "a", "b").distinct()
    step = cut_lineage(pairs.withColumn("edge", F.monotonically_increasing_id()), "chain-steps")
    most = cut_lineage(
        step.groupBy("graph").agg(F.when(F.count("*") > large, min(depth, large_depth)).otherwise(depth).alias("most")), "chain-most"
    )
    front = step.select("graph", F.col("b").alias("a")).distinct()
    walked = front.select("graph", F.lit(1).alias("hops")).distinct()
    for k in range(2, depth + 1):
        front = cut_lineage(front.join(step, ["graph", "a"]).select("graph", F.col("b").alias("a")).distinct(), "chain")
        walked = walked.unionByName(front.select("graph", F.lit(k).alias("hops")).distinct())
        if front.isEmpty():
            break
    walked = cut_lineage(walked.groupBy("graph").agg(F.max("hops").alias("hops")).join(most, "graph"), "chain-walked")
    plain = walked.where("hops < most").select("graph", F.col("hops").alias("call_depth"))
    cyclic = walked.where("hops >= most").select("graph", "most")
    step = cut_lineage(step.join(cyclic, "graph"), "chain-steps")
    current = step.select("graph", "most", F.col("b").alias("at"), F.array("edge").alias("used"))
    found = current.select("graph", F.lit(1).alias("hops")).distinct()
    onward = step.drop("most")
    for k in range(2, depth + 1):
        current = (
            current.where(F.col("most") >= k).join(onward.withColumnRenamed("a", "at"), ["graph", "at"]).where(~F.array_contains("used", F.col("edge")))
            .select("graph", "most", F.col("b").alias("at"), F.array_sort(F.array_append("used", F.col("edge"))).alias("used"))
        )
        current = cut_lineage(current.distinct(), "chain-paths")
        found = found.unionByName(current.select("graph", F.lit(k).alias("hops")).distinct())
        if current.isEmpty():
            break
    return plain.unionByName(found.groupBy("graph").agg(F.max("hops").alias("call_depth")))


def impact(g: Graph, depth: int = 5, name: str | None = None) -> DataFrame:
    """Blast radius of symbols that are called: affected callers, packages, communities, risk and its band.

    ``name`` names the symbols that are asked for; without it every one is.
    Callers are found by reverse breadth-first search over numbers.  Confidence
    falls by 0.2 a hop to 0.1 at least; risk is callers times (1 + 0.1 packages
    + 0.15 further communities).
    """
    calls = g.calls()
    about = _nodes_of(calls).join(g.symbols.select(*NODE, "community"), NODE, "left")
    about = cut_lineage(about.withColumn("package", package_of(F.col("file"))), "impact-nodes")
    step = _steps(about.select(*NODE, "id"), calls, backward=True)
    called = step.select(F.col("a").alias("id")).distinct()
    if name is not None:
        called = called.join(about.where(F.col("name") == name).select("id"), "id", "left_semi")
    found = reach_ids(step, called, depth).join(about.select(F.col("id").alias("node"), "package", "community"), "node")
    confidence = F.greatest(F.lit(0.1), 1 - 0.2 * (F.col("distance") - 1))
    rolled = found.groupBy("seed").agg(
        F.count("*").alias("callers"),
        F.size(F.collect_set("package")).cast("bigint").alias("packages"),
        F.size(F.collect_set("community")).cast("bigint").alias("communities"),
        F.round(F.avg(confidence), 6).alias("confidence"),
        F.max("distance").alias("depth"),
    )
    risk = F.col("callers") * (
        1 + 0.1 * F.col("packages") + 0.15 * F.greatest(F.col("communities") - 1, F.lit(0))
    )
    band = (
        F.when(F.col("callers") == 0, "none")
        .when((F.col("callers") <= 5) & (F.col("packages") <= 2), "low")
        .when((F.col("callers") <= 20) & (F.col("packages") <= 5), "medium")
        .otherwise("high")
    )
    return rolled.join(about.select(*NODE, F.col("id").alias("seed")), "seed").select(
        *NODE, "callers", "packages", "communities", "confidence", "depth", F.round(risk, 6).alias("risk"), band.alias("band")
    )


def components(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """``id, component``: the smallest id that each id of ``pairs`` (a, b) is connected with.

    Alternates least neighbours with pointer jumping, so that the rounds grow
    with the logarithm of the longest path; nothing is collected.
    """
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("to")).union(pairs.select("b", "a")).distinct()
    both = cut_lineage(both, "component-edges")
    label = cut_lineage(both.groupBy("id").agg(F.least(F.min("to"), F.first("id")).alias("component")), "component")
    for _ in range(rounds):
        near = both.join(label.select(F.col("id").alias("to"), F.col("component").alias("c")), "to")
        near = near.groupBy("id").agg(F.min("c").alias("c"))
        moved = label.join(near, "id").select("id", F.least("component", "c").alias("component"))
        jump = moved.select(F.col("id").alias("component"), F.col("component").alias("further"))
        moved = moved.join(jump, "component", "left").select(
            "id", F.least("component", F.coalesce("further", "component")).alias("component")
        )
        moved = cut_lineage(moved, "component")
        changed = moved.join(label.withColumnRenamed("component", "before"), "id").where("component <> before")
        label = moved
        if changed.isEmpty():
            break
    return label


def surprise_scores(g: Graph, ranked: DataFrame) -> DataFrame:
    """Score 0 to 6 of every call: +2 across packages, +1 each across communities, files, from rim to hub, and rank ratio over 10."""
    ends = g.calls().select(F.col("graph"), F.col("src").alias("name"), F.col("src_file").alias("file")).unionByName(
        g.calls().select("graph", F.col("dst").alias("name"), F.col("dst_file").alias("file"))
    )
    degree = ends.groupBy(*NODE).agg(F.count("*").alias("degree"))
    about = g.symbols.select(*NODE, "community").join(degree, NODE).join(ranked, NODE)

    def side(end: str) -> DataFrame:
        return about.select(
            "graph", F.col("name").alias(end), F.col("file").alias(f"{end}_file"),
            *[F.col(c).alias(f"{end}_{c}") for c in ("community", "degree", "pagerank")],
        )

    joined = g.calls().join(side("src"), ["graph", "src", "src_file"]).join(side("dst"), ["graph", "dst", "dst_file"])
    low, high = F.least("src_degree", "dst_degree"), F.greatest("src_degree", "dst_degree")
    ratio = F.greatest("src_pagerank", "dst_pagerank") / F.least("src_pagerank", "dst_pagerank")

    def one(condition: Column, points: int = 1) -> Column:
        return F.when(condition, points).otherwise(0)

    score = (
        one(package_of(F.col("src_file")) != package_of(F.col("dst_file")), 2)
        + one(F.col("src_community") != F.col("dst_community"))
        + one((low <= 2) & (high >= 5))
        + one(ratio > 10)
        + one(F.col("src_file") != F.col("dst_file"))
    )
    return joined.select("graph", "src", "src_file", "dst", "dst_file", score.alias("score"))


def node_surprise(scores: DataFrame) -> DataFrame:
    """The greatest score of each symbol's calls, as a share of 6."""
    ends = scores.select("graph", F.col("src").alias("name"), F.col("src_file").alias("file"), "score").unionByName(
        scores.select("graph", F.col("dst").alias("name"), F.col("dst_file").alias("file"), "score")
    )
    return ends.groupBy(*NODE).agg(F.round(F.max("score") / 6, 6).alias("surprise"))


def seed_neighbours(g: Graph, seeds: DataFrame) -> DataFrame:
    """Symbols one call away from the seeds in either direction that are no seeds."""
    down = g.calls().select(*["graph", F.col("src").alias("name")], F.col("dst").alias("next"), F.col("dst_file").alias("file"))
    up = g.calls().select(*["graph", F.col("dst").alias("name")], F.col("src").alias("next"), F.col("src_file").alias("file"))
    near = seeds.select("graph", "name").distinct().join(down.unionByName(up), ["graph", "name"])
    near = near.select("graph", F.col("next").alias("name"), "file").distinct()
    return near.join(seeds.select("graph", "name"), ["graph", "name"], "left_anti")


def two_cycles(imports: DataFrame) -> DataFrame:
    """Pairs of packages that import each other; ``imports``: graph, file, package."""
    pairs = imports.where(~F.col("file").rlike(r"(?:_test\.|\.test\.|\.spec\.|(?:^|/)tests?/)")).select(
        "graph", package_of(F.col("file")).alias("a"), F.col("package").alias("b")
    ).distinct()
    back = pairs.select("graph", F.col("b").alias("a"), F.col("a").alias("b"))
    return pairs.join(back, ["graph", "a", "b"]).where(F.col("a") < F.col("b"))


# --- Algorithms whose result depends on an order of steps: one task a graph -----------------------------------


def louvain_levels(
    edges: dict[tuple[str, str], float], nodes: list[str], resolution: float = 1.0, summed: bool = True
) -> dict[str, int]:
    """Communities by sequential local moves and contraction; ties go to the lowest community number.

    Nodes are visited in sorted order, at most 50 passes a level and 10 levels;
    loops that contraction makes are dropped and weights between communities
    are summed, or 1 if not ``summed``.
    """
    members = {k: [n] for k, n in enumerate(sorted(nodes))}
    number = {n: k for k, n in enumerate(sorted(nodes))}
    links: dict[int, dict[int, float]] = {k: {} for k in members}
    for (a, b), w in edges.items():
        if a != b and a in number and b in number:
            i, j = number[a], number[b]
            links[i][j] = links[j][i] = max(w, links[i].get(j, 0.0))
    for _ in range(10):
        total = sum(sum(x.values()) for x in links.values())
        if not total:
            break
        degree = {k: sum(x.values()) for k, x in links.items()}
        community, weight = {k: k for k in links}, dict(degree)
        moved_once = False
        for _ in range(50):
            moved = False
            for k in sorted(links):
                own, to = community[k], {}
                for j, w in links[k].items():
                    to[community[j]] = to.get(community[j], 0.0) + w
                weight[own] -= degree[k]
                gain = {c: w - resolution * degree[k] * weight[c] / total for c, w in {own: to.get(own, 0.0), **to}.items()}
                best = max(gain, key=lambda c: (gain[c], c == own, -c))
                weight[best] += degree[k]
                if best != own and gain[best] > gain[own] + 1e-12:
                    community[k], moved, moved_once = best, True, True
                elif best != own:
                    weight[best] -= degree[k]
                    weight[own] += degree[k]
            if not moved:
                break
        if not moved_once:
            break
        renumber = {c: k for k, c in enumerate(sorted(set(community.values())))}
        if len(renumber) == 1:  # a level at which all fall into one says nothing and is not taken over
            break
        merged: dict[int, list[str]] = {k: [] for k in renumber.values()}
        joined: dict[int, dict[int, float]] = {k: {} for k in renumber.values()}
        for k, c in community.items():
            merged[renumber[c]] += members[k]
            for j, w in links[k].items():
                if community[j] != c:
                    target = joined[renumber[c]]
                    target[renumber[community[j]]] = target.get(renumber[community[j]], 0.0) + w if summed else 1.0
        members, links = merged, joined
    return {n: k for k, c in enumerate(sorted(members.values(), key=min)) for n in c}


#: Weights of edge labels in community detection.
LABEL_WEIGHTS = {"CALLS": 3.0, "IMPLEMENTS": 2.0, "INHERITS": 2.0, "TESTED_BY": 1.0}


def louvain(g: Graph, weighted: bool = True, resolution: float = 1.0) -> DataFrame:
    """``graph, name, file, detected``: communities of each graph.

    Moves are sequential, so that a graph is one task, whatever its size; many
    small graphs share a task.
    """
    ship_package(g.symbols.sparkSession)
    weight = F.lit(0.0)
    for label, w in LABEL_WEIGHTS.items():
        weight = F.when(F.col("label") == label, w if weighted else 1.0).otherwise(weight)
    key = F.concat_ws("\0", "name", "file")
    nodes = g.symbols.select("graph", key.alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("w"))
    links = g.edges.select(
        "graph", F.concat_ws("\0", "src", "src_file").alias("a"), F.concat_ws("\0", "dst", "dst_file").alias("b"), weight.alias("w")
    ).where("w > 0")
    bucket = _bucket(graph_sizes(nodes, links), SMALL_GRAPH)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for graph, own in rows.groupby("graph", sort=False):
            linked = own["b"].notna().to_numpy()
            a, b, w = (own.loc[linked, c].to_numpy() for c in ("a", "b", "w"))
            pairs: dict[tuple[str, str], float] = {}
            for x, y, z in zip(a, b, w, strict=True):
                pair = (x, y) if x < y else (y, x)
                if z > pairs.get(pair, 0.0):
                    pairs[pair] = z
            found = louvain_levels(pairs, own.loc[~linked, "a"].tolist(), resolution, summed=weighted)
            names = [k.split("\0", 1) for k in found]
            parts.append(pd.DataFrame({"graph": graph, "name": [n[0] for n in names], "file": [n[1] for n in names], "detected": list(found.values())}))
        return pd.concat(parts)

    return nodes.unionByName(links).groupBy(bucket).applyInPandas(run, "graph bigint, name string, file string, detected int")


def flows(g: Graph, ranked: DataFrame, handlers: DataFrame | None = None, depth: int = 8, limit: int = 50) -> DataFrame:
    """Execution flows: from entry points along calls inside their community, depth first.

    An entry is a function or method that handles a route (``handlers``: graph,
    name, file), or that is exported and never called.  ``graph, entry,
    entry_file, leaf, members, priority``; the leaf is the member of greatest
    rank besides the entry (the entry itself if it is alone), the priority the
    greatest rank.  At most ``limit`` flows a graph, by priority.

    A flow never leaves its community: calls that leave it are dropped before,
    and of a graph beyond ``SMALL_GRAPH`` nodes and calls each community is a
    task of its own.
    """
    ship_package(g.symbols.sparkSession)
    calls = g.calls()
    called = calls.select("graph", F.col("dst").alias("name"), F.col("dst_file").alias("file")).distinct()
    exported = is_exported(F.col("name"), F.coalesce("language", F.lit("")))
    able = g.symbols.where(F.col("kind").isin("function", "method")).withColumn("language", language_of(F.col("file")))
    entries = able.where(exported).join(called, NODE, "left_anti").select(*NODE)
    if handlers is not None:
        entries = entries.unionByName(able.join(handlers.select(*NODE), NODE, "left_semi").select(*NODE))
    key = F.concat_ws("\0", "name", "file")
    nodes = (
        g.symbols.join(ranked, NODE).join(entries.distinct().withColumn("entry", F.lit(True)), NODE, "left")
        .select("graph", F.coalesce("community", F.lit(0)).alias("community"), key.alias("a"), F.coalesce("entry", F.lit(False)).alias("entry"), "pagerank")
    )
    nodes = cut_lineage(nodes, "flow-nodes")
    links = calls.select(
        "graph", F.concat_ws("\0", "src", "src_file").alias("a"), F.concat_ws("\0", "dst", "dst_file").alias("b")
    )
    own = links.join(nodes.select("graph", "a", "community"), ["graph", "a"]).join(
        nodes.select("graph", F.col("a").alias("b"), "community"), ["graph", "b", "community"]
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        about = rows[rows["b"].isna()]
        rank = dict(zip(zip(about["graph"], about["a"]), about["pagerank"]))
        calls: dict[tuple[int, str], list[tuple[int, str]]] = {}
        for graph, a, b in rows.loc[rows["b"].notna(), ["graph", "a", "b"]].sort_values(["graph", "a", "b"]).itertuples(index=False):
            calls.setdefault((graph, a), []).append((graph, b))
        found = []
        for entry in about.loc[about["entry"].eq(True), ["graph", "a"]].sort_values(["graph", "a"]).itertuples(index=False, name=None):
            seen: dict[tuple[int, str], None] = {}
            stack = [(entry, 0)]
            while stack:
                node, at = stack.pop()
                if node in seen:
                    continue
                seen[node] = None
                if at < depth:
                    stack += [(n, at + 1) for n in reversed(calls.get(node, []))]
            members = list(seen)
            leaf = max(members[1:], key=lambda n: rank[n], default=entry)
            names = [n[1].split("\0")[0] for n in members]
            found.append((entry[0], *entry[1].split("\0"), leaf[1].split("\0")[0], "\n".join(names), max(rank[n] for n in members)))
        return pd.DataFrame(
            found,
            columns=["graph", "entry", "entry_file", "leaf", "members", "priority"], dtype=object,
        ).astype({"graph": "int64", "priority": "float64"})

    both = nodes.unionByName(own.select("graph", "community", "a", "b"), allowMissingColumns=True)
    sizes = graph_sizes(nodes, links)
    large = broadcast_if_bounded(sizes.where(F.col("size") > SMALL_GRAPH).select("graph", F.lit(True).alias("_large")))
    both = both.join(large, "graph", "left").select(
        "*", F.when(F.col("_large"), F.struct("graph", "community")).alias("_part"), _bucket(sizes, SMALL_GRAPH)
    )
    found = both.groupBy("_part", F.when(F.col("_part").isNull(), F.col("bucket")).alias("_bucket")).applyInPandas(
        run, "graph bigint, entry string, entry_file string, leaf string, members string, priority double"
    )
    order = Window.partitionBy("graph").orderBy(F.desc("priority"), "entry", "leaf", "entry_file")
    return found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= limit).drop("_place").withColumn(
        "members", F.split("members", "\n")
    )


def trace_tree(
    edges: DataFrame, depth: int = 5, root: str | None = None, callers: bool = False, symbols: DataFrame | None = None
) -> DataFrame:
    """Call trees, one row for each path from a root: ``graph, root, root_file, name, file, depth, cycle, unresolved``.

    Roots are the symbols named ``root``, or without it the callers nothing
    calls.  ``callers`` follows calls backward.  ``depth`` is at most 10.  A
    path that meets itself again is marked and ends; with ``symbols`` (graph,
    name, file) a call of something not among them is marked ``unresolved`` and ends.
    """
    depth = max(1, min(10, depth))
    known = edges.select("graph", "src", "src_file", "dst", "dst_file")
    if callers:
        known = known.select("graph", F.col("dst").alias("src"), F.col("dst_file").alias("src_file"), F.col("src").alias("dst"), F.col("src_file").alias("dst_file"))
    numbered = _nodes_of(known)
    step = numbered_edges(numbered, known).select("a", "b").distinct()
    if symbols is None:
        step = step.withColumn("unresolved", F.lit(False))
    else:
        there = symbols.select(*NODE).distinct().join(numbered, NODE).select(F.col("id").alias("b"), F.lit(True).alias("_there"))
        step = step.join(there, "b", "left").select("a", "b", F.col("_there").isNull().alias("unresolved"))
    step = cut_lineage(step, "trace-steps")
    if root is None:
        roots = step.select(F.col("a").alias("id")).distinct().join(step.select(F.col("b").alias("id")), "id", "left_anti")
    else:
        roots = numbered.where(F.col("name") == root).select("id")
    no = F.lit(False)
    level = roots.select(
        F.col("id").alias("from"), F.col("id").alias("at"), F.lit(0).alias("depth"), F.array("id").alias("path"), no.alias("cycle"), no.alias("unresolved")
    )
    levels = [level]
    for k in range(1, depth + 1):
        level = level.where(~F.col("cycle") & ~F.col("unresolved")).select("from", "at", "path").join(step, F.col("at") == F.col("a")).select(
            "from", F.col("b").alias("at"), F.lit(k).alias("depth"), F.array_append("path", F.col("b")).alias("path"),
            F.array_contains("path", F.col("b")).alias("cycle"), "unresolved",
        )
        if k >= LONG_PATH:
            level = cut_lineage(level, "trace")
        levels.append(level)
    rows = reduce(DataFrame.unionByName, levels).drop("path")
    begin = numbered.select("graph", F.col("name").alias("root"), F.col("file").alias("root_file"), F.col("id").alias("from"))
    return rows.join(begin, "from").join(numbered.select("name", "file", F.col("id").alias("at")), "at").select(
        "graph", "root", "root_file", "name", "file", "depth", "cycle", "unresolved"
    )


def rank_in_graph(ranked: DataFrame) -> DataFrame:
    """Place of each node in its graph by PageRank, ties by name."""
    order = Window.partitionBy("graph").orderBy(F.desc("pagerank"), "name", "file")
    return ranked.withColumn("place", F.row_number().over(order))
