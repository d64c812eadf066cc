"""Retrieval: BM25F, trigrams, dense and sparse vectors, fusion of ranked lists, evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import stats
from cartolith.functions.text import cosine, field_tokens, set_similarity, trigrams
from cartolith.session import broadcast_if_bounded, cut_lineage

#: Weights of the fields, and the two parameters of BM25F.
FIELD_WEIGHTS, K1, B = {"symbol": 5.0, "path": 5.0, "doc": 2.0}, 1.2, 0.75
#: Terms that all queries of one call may have together.
MOST_TERMS = 1000
#: Weights of the arms of fused retrieval.
ARM_WEIGHTS = {"semantic": 1.0, "keyword": 0.5, "sparse": 0.0, "graph": 0.25, "hotspot": 0.15, "recency": 0.1}


def bm25f(docs: DataFrame, queries: DataFrame, low_priority: Column | None = None) -> DataFrame:
    """``query, doc, score`` of documents (doc, symbol, path, doc_text) for queries (query, term).

    Length and the counts of the queries' own terms (at most ``MOST_TERMS``)
    are taken from a document's tokens in its own row, in one pass that writes
    no tokens; the corpus' size, mean length and the terms' frequencies follow
    from that small table.  The length is 5 for each token of the symbol, 2 for
    a comment and 5 for the path.  The counts of documents for which
    ``low_priority`` holds are divided by 5.
    """
    found = queries.select("term").distinct().limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} query terms")
    terms = F.array(*[F.lit(t) for t in sorted(r["term"] for r in found if r["term"])]).cast("array<string>")

    def tokens(column: str, compact: bool) -> Column:
        return field_tokens(F.coalesce(column, F.lit("")), compact=compact)

    low = F.lit(False) if low_priority is None else F.coalesce(low_priority, F.lit(False))
    fields = docs.select(
        "doc", low.alias("low"), tokens("symbol", True).alias("s"), tokens("path", True).alias("p"), tokens("doc_text", False).alias("d"),
        F.when(F.length("doc_text") > 0, FIELD_WEIGHTS["doc"]).otherwise(0.0).alias("docs"),
    )

    def count(term: Column) -> Column:
        parts = [F.size(F.filter(c, lambda t: t == term)) * FIELD_WEIGHTS[name] for c, name in (("s", "symbol"), ("p", "path"), ("d", "doc"))]
        return reduce(lambda x, y: x + y, parts)

    hits = F.filter(F.transform(terms, lambda t: F.struct(t.alias("term"), count(t).alias("tf"))), lambda x: x["tf"] > 0)
    length = FIELD_WEIGHTS["symbol"] * F.size("s") + F.col("docs") + FIELD_WEIGHTS["path"]
    measured = cut_lineage(fields.select("doc", "low", length.alias("length"), hits.alias("hits")), "bm25-documents")
    corpus = measured.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    counts = measured.select("doc", "low", "length", F.inline("hits"))
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    joined = counts.join(F.broadcast(frequency), "term").crossJoin(F.broadcast(corpus))  # at most MOST_TERMS rows, and one row
    tf = F.when(F.col("low"), F.col("tf") / 5).otherwise(F.col("tf"))
    norm = 1 - B + B * F.col("length") / F.col("mean")
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    scored = joined.select("doc", "term", (idf * tf * (K1 + 1) / (tf + K1 * norm)).alias("part"))
    return scored.join(broadcast_if_bounded(queries.select("query", "term").distinct()), "term").groupBy("query", "doc").agg(
        F.round(F.sum("part"), 6).alias("score")
    )


def trigram_scores(docs: DataFrame, query: str, least: float = 0.1) -> DataFrame:
    """``doc, score, distance`` of documents (doc, name, path) similar to ``query`` by name or path."""
    wanted = trigrams(F.lit(query))
    name, path = set_similarity(trigrams(F.col("name")), wanted), set_similarity(trigrams(F.col("path")), wanted)
    sims = docs.select("doc", name.alias("ns"), path.alias("ps")).where((F.col("ns") > least) | (F.col("ps") > least))
    score = (2 * F.col("ns") + F.col("ps")) / 3
    return sims.select(
        "doc", F.round(score, 6).alias("score"), F.round(F.greatest(F.lit(0.25), 0.75 - 0.5 * score), 6).alias("distance")
    )


def dense_neighbours(rows: DataFrame, query: Sequence[float], k: int = 20, most: float | None = None) -> DataFrame:
    """``id, distance``: the k rows (id, vec) nearest to one query vector by cosine distance."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    found = rows.select("id", F.round(1 - cosine(F.col("vec"), wanted), 6).alias("distance")).where("distance IS NOT NULL")
    found = found if most is None else found.where(F.col("distance") <= most)
    return found.orderBy("distance", "id").limit(max(1, min(100, k)))


def sparse_scores(docs: DataFrame, query: DataFrame) -> DataFrame:
    """``doc, score``: inner product of sparse vectors (doc, term, w) with the query's (term, w)."""
    return (
        docs.join(broadcast_if_bounded(query.select("term", F.col("w").alias("qw"))), "term")
        .groupBy("doc").agg(F.round(F.sum(F.col("w") * F.col("qw")), 6).alias("score"))
    )


def fuse_ranks(arms: DataFrame, weights: dict[str, float] | None = None, base: int = 60, window: int | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of (query, arm, doc, place): ``query, doc, score, source``.

    Source is the arm, or hybrid if several arms found the document.  Arms of
    weight 0 take no part.
    """
    weights = ARM_WEIGHTS if weights is None else weights
    weight = reduce(lambda c, a: c.when(F.col("arm") == a[0], a[1]), list(weights.items())[1:], F.when(F.col("arm") == next(iter(weights)), next(iter(weights.values()))))
    usable = arms.withColumn("w", weight.otherwise(0.0)).where("w > 0")
    if window is not None:
        usable = usable.where(F.col("place") <= window)
    return usable.groupBy("query", "doc").agg(
        F.round(F.sum(F.col("w") / (base + F.col("place"))), 9).alias("score"),
        F.when(F.count_distinct("arm") > 1, "hybrid").otherwise(F.min("arm")).alias("source"),
    )


def fuse_scores(signals: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``file, score``: min-max scaled signals (file, <signal>...) summed by weight; missing signals are 0."""
    ranges = signals.agg(*[f(s).alias(f"_{n}_{s}") for s in weights for n, f in (("low", F.min), ("high", F.max))])
    joined = signals.crossJoin(F.broadcast(ranges))  # one row
    score = reduce(
        lambda a, b: a + b,
        [w * F.coalesce(stats.min_max(F.col(s), F.col(f"_low_{s}"), F.col(f"_high_{s}")), F.lit(0.0)) for s, w in weights.items()],
    )
    return joined.select("file", F.round(score, 6).alias("score"))


def demote_stale(results: DataFrame, indexed_at: Column) -> DataFrame:
    """Places with rows updated more than a minute before ``indexed_at`` after all fresh ones, else in order."""
    stale = F.coalesce(F.col("updated_at") < indexed_at - F.expr("INTERVAL 1 MINUTE"), F.lit(False))
    order = Window.partitionBy("query").orderBy("stale", "place")
    return results.withColumn("stale", stale).withColumn("new_place", F.row_number().over(order))


def matched_labels(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """``query, label, place``: the best place at which a hit (query, place, file, symbol) meets each label (query, label).

    A label without a colon is a symbol; with one it is the end of a file's
    path and a symbol.  Labels and hits are joined on the symbol.
    """
    text = F.trim("label")
    named = labels.where(text != "").select(
        "query", "label", F.when(F.instr(text, ":") > 0, F.substring_index(text, ":", 1)).alias("_end"), F.regexp_replace(text, "^[^:]*:", "").alias("symbol")
    )
    met = named.join(hits, ["query", "symbol"]).where(F.col("_end").isNull() | F.endswith("file", F.col("_end")))
    return met.groupBy("query", "label").agg(F.min("place").alias("place"))


def label_recall(hits: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """``query, recall``: of a query's distinct labels the share that a hit among its first k meets."""
    total = labels.where(F.trim("label") != "").groupBy("query").agg(F.count_distinct("label").alias("_n"))
    found = matched_labels(hits.where(F.col("place") <= k), labels).groupBy("query").agg(F.count("*").alias("_k"))
    return total.join(found, "query", "left").select("query", F.round(F.coalesce("_k", F.lit(0)) / F.col("_n"), 6).alias("recall"))


def ranking_metrics(judged: DataFrame, total: DataFrame) -> DataFrame:
    """nDCG@10, recall@10, recall@20 and reciprocal rank of each query.

    ``judged``: query, place, relevant (0 or 1); ``total``: query, n relevant in all.
    """
    place, hit = F.col("place"), F.col("relevant") == 1
    rolled = judged.groupBy("query").agg(
        F.sum(F.when(hit & (place <= 10), 1 / F.log2(place + 1)).otherwise(0.0)).alias("dcg"),
        F.count_if(hit & (place <= 10)).alias("at10"),
        F.count_if(hit & (place <= 20)).alias("at20"),
        F.min(F.when(hit, place)).alias("first"),
    ).join(total, "query")
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)
    )
    known = F.col("n") > 0
    return rolled.select(
        "query",
        F.round(F.when(known, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg10"),
        F.round(F.when(known, F.col("at10") / F.col("n")).otherwise(0.0), 6).alias("recall10"),
        F.round(F.when(known, F.col("at20") / F.col("n")).otherwise(0.0), 6).alias("recall20"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
    )


def mean_metrics(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Means overall and by each of ``by``, as grouping sets: null stands for all."""
    names = ["ndcg10", "recall10", "recall20", "mrr"]
    sets = [[F.col(b)] for b in by] + [[]]
    return metrics.groupingSets(sets, *[F.col(b) for b in by]).agg(
        F.count("*").alias("queries"), *[F.round(F.avg(n), 6).alias(n) for n in names]
    )


def percentiles(rows: DataFrame, group: str, value: str, at: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles of each group, exact; values are counted before the shuffle."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.partitionBy(group).orderBy(value))
    total = F.sum("n").over(Window.partitionBy(group))
    placed = counts.withColumns({"run": run, "total": total})
    return placed.groupBy(group).agg(
        *[F.min(F.when(F.col("run") >= F.ceil(p * F.col("total")), F.col(value))).alias(f"p{round(p * 100)}") for p in at]
    )


def match_density(hits: DataFrame, per: str = "file") -> DataFrame:
    """Hits (file, line) with the number of hits in their file, for ranking by density."""
    counts = hits.groupBy(per).agg(F.count("*").alias("hits"), F.min("line").alias("first_line"))
    return hits.join(counts, per)


def grep_lines(files: DataFrame, pattern: str, context: int = 1) -> DataFrame:
    """``repo, path, line, text, around``: lines that match, with ``context`` lines on both sides."""
    lines = F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n")
    found = files.where(F.col("content").rlike(pattern)).select(
        "repo", "path", lines.alias("all"), F.posexplode(lines).alias("at", "text")
    ).where(F.col("text").rlike(pattern))
    start = F.greatest(F.col("at") + 1 - context, F.lit(1))
    size = F.col("at") + 1 + context - start + 1
    return found.select(
        "repo", "path", (F.col("at") + 1).alias("line"), "text", F.array_join(F.slice("all", start, size), "\n").alias("around")
    )


def innermost_spans(points: DataFrame, spans: DataFrame, stripe: int = 64) -> DataFrame:
    """``point_id, name``: the smallest span (repo, file, start_line, end_line, name) around each point (point_id, repo, file, line).

    Equal spans go by start and name.  A span is cut into stripes of ``stripe``
    lines and meets the points of its stripes only.
    """
    def stripes(line: str) -> Column:
        return F.floor(F.col(line) / stripe)

    cut = spans.where("start_line <= end_line").withColumn("stripe", F.explode(F.sequence(stripes("start_line"), stripes("end_line"))))
    joined = points.withColumn("stripe", stripes("line")).join(cut, ["repo", "file", "stripe"])
    joined = joined.where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    size = F.struct(F.col("end_line") - F.col("start_line"), "start_line", "name")
    return joined.groupBy("point_id").agg(F.min_by("name", size).alias("name"))


def preceding_symbols(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``point_id, name``: the nearest symbol that starts at or before each point (as-of join, backward).

    Points and starts are sorted together within their file, and the last start
    is carried on; nothing is multiplied.
    """
    starts = spans.groupBy("repo", "file", F.col("start_line").alias("line")).agg(F.max("name").alias("name"))
    both = starts.select("repo", "file", "line", "name").unionByName(points.select("repo", "file", "line", "point_id"), allowMissingColumns=True)
    order = Window.partitionBy("repo", "file").orderBy("line", F.col("point_id").isNotNull())
    carried = both.withColumn("name", F.last("name", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return carried.where(F.col("point_id").isNotNull() & F.col("name").isNotNull()).select("point_id", "name")


def overlapping_spans(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of spans in the same file that overlap: ``a``: repo, file, a_id, a_start, a_end; ``b`` likewise."""
    return a.join(b, ["repo", "file"]).where((F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end"))).select(
        "repo", "file", "a_id", "b_id"
    )


def diverse_selection(
    candidates: list[tuple[str, float, int, frozenset[str]]], budget: int, trade: float = 0.7, keep_first: bool = False
) -> list[str]:
    """Greedy choice of (id, relevance, size, tokens) by relevance less similarity to what is chosen, within a budget.

    For the candidates of one answer; what does not fit is passed over, with
    ``keep_first`` except for the first.  Each candidate's greatest similarity
    is kept and compared with the latest choice only.
    """
    left = {c[0]: c for c in sorted(candidates, key=lambda c: c[0])}
    near = dict.fromkeys(left, 0.0)
    chosen, room = [], budget
    while left:
        best = max(left.values(), key=lambda c: trade * c[1] - (1 - trade) * near[c[0]])
        del left[best[0]]
        if best[2] > room and (chosen or not keep_first):
            continue
        chosen.append(best[0])
        room -= best[2]
        for c in left.values():
            near[c[0]] = max(near[c[0]], len(c[3] & best[3]) / max(1, len(c[3] | best[3])))
    return chosen


def global_rank(scores: DataFrame, key: str) -> DataFrame:
    """Add ``place`` to scores (key, score), greatest first, ties by key, without one task for all rows.

    Rows are cut by range into partitions, whose sizes are added up.
    """
    order = [F.desc("score"), F.col(key)]
    cut = cut_lineage(scores.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "rank-ranges")
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    within = Window.partitionBy("_part").orderBy(*order)
    return cut.join(F.broadcast(before), "_part").withColumn("place", F.row_number().over(within) + F.col("_before")).drop("_part", "_before")
