"""Hybrid search and research: arms over names, graph and history, their fusion, expansion, and a choice within a budget."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions.predicates import is_low_priority, is_test_file
from cartolith.operators import retrieval
from cartolith.operators.graph_algorithms import pagerank
from cartolith.session import broadcast_if_bounded, cut_lineage, ship_package

#: Candidates fetched for each wanted result, and at least.
FANOUT, LEAST_CANDIDATES = 10, 50
#: Weights of the parts of a file's rank.
FILE_WEIGHTS = {"bm25": 0.5, "rank": 0.3, "exact": 0.2}
#: What a step away from the seeds takes off a file's score, and the score of files that are no seeds.
HOP_DECAY, FLOOR = 0.5, 0.1
#: Score of a test beside the file it tests.
SIBLING = 0.8


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w.lower()) for w in words]).cast("array<string>")


def candidate_bm25(docs: DataFrame, terms: list[str], k: int = 20) -> DataFrame:
    """``doc, score``: the best k of documents (doc, name, path) for the terms of one query.

    The documents nearest by trigrams are fetched first, ten for each wanted
    result and 50 at least; counts and frequencies are those of these
    candidates alone.
    """
    if not terms:
        return docs.select("doc", F.lit(0.0).alias("score")).limit(0)
    near = retrieval.trigram_scores(docs, " ".join(terms)).orderBy(F.desc("score"), "doc").limit(max(FANOUT * k, LEAST_CANDIDATES))
    chosen = docs.join(F.broadcast(near.select("doc")), "doc", "left_semi").select(  # at most 10 k rows
        "doc", F.col("name").alias("symbol"), "path", F.lit(None).cast("string").alias("doc_text")
    )
    asked = docs.sparkSession.createDataFrame([("q", t) for t in terms], "query string, term string")
    scored = retrieval.bm25f(chosen, asked, is_low_priority(F.col("path")))
    return scored.select("doc", "score").orderBy(F.desc("score"), "doc").limit(k)


def first_of_each(parts: list[DataFrame], keys: list[str], limit: int | None = None) -> DataFrame:
    """Rows of the parts (with ``place``) in the order of the parts, the first of each key; at most ``limit``."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(n)) for n, p in enumerate(parts)])
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("part", "place")).alias("v")).select(*keys, "v.*")
    return kept if limit is None else kept.orderBy("part", "place", *keys).limit(limit)


def nearest_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row with the least ``distance``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("distance", *[c for c in rest if c != "distance"])).alias("v")).select(*keys, "v.*")


def graph_candidates(
    symbols: DataFrame, calls: DataFrame, terms: list[str], seeds: DataFrame, k: int = 20, top: int = 3, fan: int = 10, hops: int = 2
) -> DataFrame:
    """``name, file, arm``: up to k symbols that the graph adds to the seeds of a search, in order.

    ``symbols``: name, file, community, pagerank; ``calls``: src, src_file, dst,
    dst_file; ``seeds``: name, file, place.  First the symbols of greatest rank
    whose name or file has a term, then ``fan`` callees of each of the best
    ``top`` seeds within ``hops`` calls, then symbols of the best seed's
    community; seeds themselves are left out, and each symbol is taken once.
    """
    words = _literal(terms)
    text = F.lower(F.concat_ws("\n", "name", "file"))
    new = symbols.join(broadcast_if_bounded(seeds.select("name", "file")), ["name", "file"], "left_anti")
    named = symbols.where(F.exists(words, lambda w: F.instr(text, w) > 0) & F.col("pagerank").isNotNull())
    named = named.orderBy(F.desc("pagerank"), "name", "file").limit(k)
    order = Window.orderBy(F.desc("pagerank"), "name", "file")
    ranked = named.withColumn("place", F.row_number().over(order)).select("name", "file", "place", F.lit("rank").alias("arm"))  # k rows

    best = seeds.orderBy("place").limit(top).select(F.col("place").alias("seed"), F.col("name").alias("src")).withColumn("hop", F.lit(0))
    step = calls.select("src", "dst", "dst_file").distinct()
    front, found = best, []
    for hop in range(1, hops + 1):
        joined = step.join(F.broadcast(front.select("seed", "src").distinct()), "src")  # a few seeds and what they call
        reached = cut_lineage(joined.select("seed", F.col("dst").alias("name"), F.col("dst_file").alias("file")).distinct(), "called")
        found.append(reached.withColumn("hop", F.lit(hop)))
        front = reached.select("seed", F.col("name").alias("src"))
    near = reduce(DataFrame.unionByName, found).groupBy("seed", "name", "file").agg(F.min("hop").alias("hop"))
    fans = Window.partitionBy("seed").orderBy("hop", "name", "file")
    near = near.withColumn("at", F.row_number().over(fans)).where(F.col("at") <= fan)
    called = near.select("name", "file", (F.col("seed") * 1000 + F.col("at")).alias("place"), F.lit("calls").alias("arm"))

    home = symbols.join(F.broadcast(seeds.orderBy("place").limit(1).select("name")), "name").orderBy("file").select("community").limit(1)
    members = symbols.join(F.broadcast(home.where("community IS NOT NULL")), "community").orderBy("name", "file").limit(k)  # one row
    members = members.withColumn("place", F.row_number().over(Window.orderBy("name", "file"))).select("name", "file", "place", F.lit("community").alias("arm"))

    merged = first_of_each([ranked, called, members], ["name", "file"])
    fresh = merged.join(new.select("name", "file").distinct(), ["name", "file"], "left_semi")
    return fresh.orderBy("part", "place", "name", "file").limit(k).select("name", "file", "arm")


def signal_arm(candidates: DataFrame, signal: DataFrame, value: str, arm: str, k: int = 20) -> DataFrame:
    """``query, arm, doc, place``: candidates (query, doc, file, place) by a value of their file, greatest first; without one they come last.

    Ties keep the candidates' order.
    """
    joined = candidates.join(signal.select("file", F.col(value).alias("_v")), "file", "left")
    order = Window.partitionBy("query").orderBy(F.desc_nulls_last("_v"), F.col("place"), "doc")
    placed = joined.withColumn("new", F.row_number().over(order)).where(F.col("new") <= k)
    return placed.select("query", F.lit(arm).alias("arm"), "doc", F.col("new").alias("place"))


def seed_weights(symbols: DataFrame, terms: list[str]) -> DataFrame:
    """``file, seed, exact``: 10 for each symbol (file, name) that is a term, else 1 for each term it holds; and how many are terms."""
    words, name = _literal(list(dict.fromkeys(t.lower() for t in terms))), F.lower("name")
    equal = F.array_contains(words, name)
    held = F.size(F.filter(words, lambda w: F.instr(name, w) > 0)).cast("double")
    scored = symbols.select("file", F.when(equal, 10.0).otherwise(held).alias("seed"), equal.cast("double").alias("exact"))
    return scored.groupBy("file").agg(F.sum("seed").alias("seed"), F.sum("exact").alias("exact")).where("seed > 0")


def boost_by_names(scores: DataFrame, hits: DataFrame, boost: float = 0.3) -> DataFrame:
    """Scores (file, score) of files with ``boost`` added for each hit (file); files without a score are not added."""
    counts = hits.groupBy("file").agg(F.count("*").alias("_n"))
    return scores.join(counts, "file", "left").select("file", F.round(F.col("score") + boost * F.coalesce("_n", F.lit(0)), 6).alias("score"))


def file_rank(files: DataFrame, symbols: DataFrame, links: DataFrame, terms: list[str], rrf: bool = False) -> DataFrame:
    """``file, score``: files by text, structure and exact names, each scaled to 0..1 and weighted 0.5, 0.3 and 0.2.

    ``files``: file, doc_text; ``symbols``: file, name; ``links``: src, dst,
    weight (references between files).  Text is BM25F over a file's names, path
    and comments; structure is PageRank with the files whose names match as
    seeds.  ``rrf`` fuses ranks instead, with weights 1, 1.5 and 0.5.
    """
    names = symbols.groupBy("file").agg(F.concat_ws(" ", F.array_sort(F.collect_list("name"))).alias("symbol"))
    docs = files.join(names, "file", "left").select(F.col("file").alias("doc"), F.coalesce("symbol", F.lit("")).alias("symbol"), F.col("file").alias("path"), "doc_text")
    asked = files.sparkSession.createDataFrame([("q", t) for t in terms], "query string, term string")
    text = retrieval.bm25f(docs, asked, is_low_priority(F.col("path"))).select(F.col("doc").alias("file"), F.col("score").alias("bm25"))
    seeds = cut_lineage(seed_weights(symbols, terms), "seed-weights")
    graph = F.lit(1).cast("bigint").alias("graph")
    nodes = files.select(graph, F.col("file").alias("name"), "file")
    edges = links.select(graph, "src", F.col("src").alias("src_file"), "dst", F.col("dst").alias("dst_file"), "weight")
    given = seeds.select(graph, F.col("file").alias("name"), "file", "seed")
    rank = pagerank(nodes, edges, given, weight="weight").select("file", F.col("pagerank").alias("rank"))
    signals = files.select("file").join(text, "file", "left").join(rank, "file", "left").join(seeds.select("file", "exact"), "file", "left")
    signals = cut_lineage(signals, "file-signals")
    if not rrf:
        return retrieval.fuse_scores(signals, FILE_WEIGHTS)
    weights = {"bm25": 1.0, "rank": 1.5, "exact": 0.5}
    arms = [
        retrieval.global_rank(signals.where(F.col(c) > 0).select("file", F.col(c).alias("score")), "file").select(
            F.lit("q").alias("query"), F.lit(c).alias("arm"), F.col("file").alias("doc"), "place"
        )
        for c in weights
    ]
    return retrieval.fuse_ranks(reduce(DataFrame.unionByName, arms), weights).select(F.col("doc").alias("file"), "score")


def expand_files(seeds: DataFrame, links: DataFrame, hops: int = 1) -> DataFrame:
    """``file, distance, why``: files within ``hops`` links of the seeds (file), each walk keeping its direction; seeds at 0.

    ``links``: src, dst.  ``why`` says along which direction a file was first
    reached: ``imports`` before ``imported_by`` at equal distance.
    """
    step = links.select("src", "dst").where("src <> dst").distinct()
    known = seeds.select("file").distinct().select("file", F.lit(0).alias("distance"), F.lit("seed").alias("why"))
    found = [known]
    for why, a, b in (("imports", "src", "dst"), ("imported_by", "dst", "src")):
        front, seen = known.select("file"), known.select("file")
        for hop in range(1, hops + 1):
            new = step.join(front.select(F.col("file").alias(a)), a).select(F.col(b).alias("file")).distinct()
            front = cut_lineage(new.join(seen, "file", "left_anti"), "expanded")
            found.append(front.select("file", F.lit(hop).alias("distance"), F.lit(why).alias("why")))
            seen = seen.unionByName(front)
    return reduce(DataFrame.unionByName, found).groupBy("file").agg(
        F.min(F.struct("distance", F.when(F.col("why") == "imported_by", 1).otherwise(0).alias("o"), "why")).alias("v")
    ).select("file", "v.distance", "v.why")


def file_calls(calls: DataFrame) -> DataFrame:
    """``src, dst``: links between the files of calls (src_file, dst_file)."""
    return calls.where("src_file <> dst_file").select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst")).distinct()


def sibling_tests(kept: DataFrame, files: DataFrame) -> DataFrame:
    """``file, score, of``: tests that stand beside kept production files (file, score) by custom, if they are among the files and not kept."""
    stem, ext = F.regexp_extract("file", r"^(.*?)\.[^./]+$", 1), F.regexp_extract("file", r"(\.[^./]+)$", 1)
    folder = F.regexp_extract("file", r"^(.*/)?[^/]*$", 1)
    base = F.regexp_extract("file", r"([^/]*?)\.[^./]+$", 1)
    both = F.array(F.concat(stem, F.lit(".test"), ext), F.concat(stem, F.lit(".spec"), ext))
    nested = F.concat(folder, F.lit("__tests__/"), base)
    candidates = (
        F.when(ext == ".go", F.array(F.concat(stem, F.lit("_test.go"))))
        .when(ext == ".py", F.array(F.concat(folder, F.lit("test_"), base, ext), F.concat(folder, F.lit("tests/test_"), base, ext)))
        .when(ext == ".rs", F.array(F.concat(stem, F.lit("_test.rs"))))
        .when(ext.isin(".ts", ".tsx", ".js", ".jsx"), both)
        .when(ext == ".svelte", F.concat(both, F.array(F.concat(nested, F.lit(".test.svelte")), F.concat(nested, F.lit(".test.ts")))))
        .when(ext == ".astro", F.concat(both, F.array(F.concat(nested, F.lit(".test.astro")))))
    )
    asked = kept.where(~is_test_file(F.col("file"))).select(F.explode(candidates).alias("test"), "file", "score")
    there = asked.join(files.select(F.col("file").alias("test")).distinct(), "test").join(kept.select(F.col("file").alias("test")), "test", "left_anti")
    best = there.groupBy("test").agg(F.min_by(F.struct("score", "file"), F.struct(-F.col("score"), "file")).alias("v"))
    return best.select(F.col("test").alias("file"), F.round(F.col("v.score") * SIBLING, 6).alias("score"), F.col("v.file").alias("of"))


#: Candidates of one answer among which the choice within a budget is made; they are the best by relevance.
MOST_CANDIDATES = 2000


def choose_within_budget(candidates: DataFrame, budget: int, trade: float = 0.7, most: int = MOST_CANDIDATES) -> DataFrame:
    """``query, id, place``: a choice among candidates (query, id, relevance, size, tokens) by relevance less likeness to what is chosen.

    Greedy by nature, so that a query is one task; it holds the query's best
    ``most`` candidates.  What does not fit the rest of the budget is passed
    over, except for the first.
    """
    ship_package(candidates.sparkSession)
    order = Window.partitionBy("query").orderBy(F.desc("relevance"), "id")
    best = candidates.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(i, r, s, frozenset(t)) for i, r, s, t in zip(group["id"], group["relevance"], group["size"], group["tokens"], strict=True)]
        chosen = retrieval.diverse_selection(rows, budget, trade, keep_first=True)
        return pd.DataFrame({"query": group["query"].iloc[0], "id": pd.Series(chosen, dtype=object), "place": range(1, len(chosen) + 1)})

    rows = best.select("query", F.col("id").cast("string").alias("id"), "relevance", "size", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    return rows.groupBy("query").applyInPandas(run, "query string, id string, place int")


def research(
    ranked: DataFrame, arms: list[DataFrame], top: DataFrame, links: DataFrame, symbols: DataFrame, terms: list[str],
    hops: int = 1, budget: int = 8000, calls: DataFrame | None = None,
) -> DataFrame:
    """``file, distance, why, score, place``: the files that answer a question, chosen within a budget of tokens.

    ``ranked``: file, score of ``file_rank``; ``arms``: further scores (file,
    score) such as vectors or trigrams, fused one after the other by rank;
    ``top``: file, pagerank of the foremost symbols, which adds 8 times their
    rank, 0.3 at most; ``links`` (and ``calls`` between files) expand the seeds.
    The score halves with each step; the cost of a file is 120 characters and
    30 more than its name for each symbol that holds a term, four to a token.
    """
    scores = ranked.where("score > 0").select("file", "score")
    for arm in arms:
        best = arm.groupBy("file").agg(F.max("score").alias("score"))
        lists = [
            retrieval.global_rank(x, "file").select(F.lit("q").alias("query"), F.lit(n).alias("arm"), F.col("file").alias("doc"), "place")
            for n, x in (("a", scores), ("b", best))
        ]
        fused = retrieval.fuse_ranks(lists[0].unionByName(lists[1]), {"a": 1.0, "b": 1.0})
        scores = cut_lineage(fused.select(F.col("doc").alias("file"), "score"), "fused-scores")
    lifted = top.groupBy("file").agg(F.sum(F.least(F.lit(0.3), 8 * F.col("pagerank"))).alias("_lift"))
    scores = scores.join(lifted, "file", "full_outer").select("file", (F.coalesce("score", F.lit(0.0)) + F.coalesce("_lift", F.lit(0.0))).alias("score"))
    scores = cut_lineage(scores.where("score > 0"), "seed-scores")
    reached = expand_files(scores, links, hops)
    if calls is not None:
        reached = first_of_each(
            [x.withColumn("place", F.col("distance")) for x in (reached, expand_files(scores, calls, hops))], ["file"]
        ).select("file", "distance", "why")
    words = _literal(terms)
    held = symbols.where(F.exists(words, lambda w: F.instr(F.lower("name"), w) > 0)).groupBy("file").agg(
        F.collect_set(F.lower("name")).alias("tokens"), F.sum(F.length("name") + 30).alias("chars")
    )
    score = F.coalesce("score", F.lit(FLOOR)) * F.pow(F.lit(HOP_DECAY), F.col("distance"))
    judged = cut_lineage(reached.join(scores, "file", "left").withColumn("score", F.round(score, 9)), "research-files")
    candidates = judged.join(held, "file", "left").select(
        F.lit("q").alias("query"), F.col("file").alias("id"), F.col("score").alias("relevance"),
        F.floor((120 + F.coalesce("chars", F.lit(0))) / 4).cast("int").alias("size"), "tokens",
    )
    chosen = choose_within_budget(candidates, budget)
    return judged.join(chosen.select(F.col("id").alias("file"), "place"), "file").select("file", "distance", "why", "score", "place")


def symbol_search(symbols: DataFrame, query: str, limit: int | None = 100) -> DataFrame:
    """Symbols (file, name, kind, ...) by how well the name meets the query, by visibility and kind; ``score`` added.

    100, 50, 25 or 10 points for an equal, beginning, containing or other name,
    none for a query of ``*`` or nothing; 30 or 10 by a capital first letter;
    25 to 5 by kind.
    """
    name, asked = F.lower("name"), query.lower()
    match = F.lit(0) if query in ("", "*") else F.when(name == asked, 100).when(F.startswith(name, F.lit(asked)), 50).when(F.instr(name, asked) > 0, 25).otherwise(10)
    shown = F.when(F.col("name").rlike(r"^\p{Lu}"), 30).otherwise(10)
    kind = (
        F.when(F.col("kind").isin("struct", "interface", "class"), 25).when(F.col("kind").isin("function", "type"), 20)
        .when(F.col("kind") == "method", 15).when(F.col("kind") == "const", 10).otherwise(5)
    )
    scored = symbols.withColumn("score", (match + shown + kind).cast("int"))
    return scored if limit is None else scored.orderBy(F.desc("score"), "file", "name", "kind").limit(min(500, limit))


def flagged_first(rows: DataFrame, flag: Column, by: list[str] | None = None) -> DataFrame:
    """Add ``new_place``: rows (with ``place``) for which ``flag`` holds before the others, else in order; within each ``by``."""
    order = Window.partitionBy(*(by or [])).orderBy(F.desc(F.coalesce(flag, F.lit(False))), "place")
    return rows.withColumn("new_place", F.row_number().over(order))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """``limit`` rows of an ordered table after the first ``offset``."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


def top_share_threshold(rows: DataFrame, value: str, group: str, parts: int = 10) -> DataFrame:
    """Of each group the value at place n // ``parts`` - 1 of n from the greatest (the least at 0), counted before the shuffle."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    run = F.sum("_n").over(Window.partitionBy(group).orderBy(F.desc(value)))
    total = F.sum("_n").over(Window.partitionBy(group))
    placed = counts.withColumns({"_run": run, "_all": total})
    at = F.greatest(F.floor(F.col("_all") / parts), F.lit(1))
    return placed.where(F.col("_run") >= at).groupBy(group).agg(F.max(value).alias("threshold"))
