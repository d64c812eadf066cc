"""One ranking from several scores on unlike scales, by distance to ideal points."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.session import BROADCAST_ROWS, cut_lineage

#: Values beyond these quantiles of their group are drawn in to them.
WINSOR = (0.05, 0.95)
#: Values up to which the quantile sketch of a group is exact, and the sketch's error of rank beyond.
EXACT, ERROR = 4_000, 1 / 10_000
#: Items from which a group is hot; the rows of hot groups are joined in so many parts.
HOT, SALTS = 100_000, 64


def _usable(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf")), value)


def _with_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """``rows`` with their group's one row of ``stats`` (``g``, ``n`` items and more); hot groups meet in parts.

    Few hot groups are broadcast by name to salt their rows; if there are more
    than ``BROADCAST_ROWS`` of them every row is salted.
    """
    hot = stats.where(F.col("n") >= HOT).select("g", F.lit(True).alias("_hot"))
    number = hot.limit(BROADCAST_ROWS + 1).count()
    if number == 0:
        return rows.join(stats, "g")
    salt = F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int")
    if number <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(hot), "g", "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
        last = F.when(F.col("n") >= HOT, SALTS - 1).otherwise(0)
    else:
        rows, last = rows.withColumn("_salt", salt), F.lit(SALTS - 1)
    return rows.join(stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))), ["g", "_salt"]).drop("_salt")


def exact_quantiles(rows: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """``g, n`` and per column ``<c>_q`` (the discrete quantiles ``shares``), ``<c>_min``, ``<c>_max`` of each group ``g``.

    The quantile of share p is the value of rank ceil(p * values).  A sketch
    holds small groups whole.  In larger ones it gives two values that enclose
    each quantile; the rows below are counted, those between are summed by
    value, and the few distinct values left are gone through in order: nothing
    holds a group in one task, and the result is exact.
    """
    around = [max(0.0, min(1.0, p + d * 2 * ERROR)) for p in shares for d in (-1, 0, 1)]
    stats = rows.groupBy("g").agg(
        F.count("*").alias("n"),
        *[f(c).alias(f"{c}_{name}") for c in columns for name, f in (("n", F.count), ("min", F.min), ("max", F.max))],
        *[F.percentile_approx(c, around, int(1 / ERROR)).alias(f"{c}_s") for c in columns],
    )
    stats = cut_lineage(stats, "quantile-sketches")
    plain = [
        F.array(*[F.col(f"{c}_s")[3 * j + 1] for j in range(len(shares))]).alias(f"{c}_q") for c in columns
    ]
    ends = [x for c in columns for x in (f"{c}_min", f"{c}_max")]
    large = reduce(lambda a, b: a | b, [F.col(f"{c}_n") > EXACT for c in columns])
    small = stats.where(~large).select("g", "n", *plain, *ends)
    large_groups = stats.where(large)
    if large_groups.isEmpty():
        return small
    met = _with_stats(rows, large_groups)
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("c"), F.lit(j).alias("j"), F.col(c).alias("v"), F.col(f"{c}_s")[3 * j].alias("lo"),
            F.col(f"{c}_s")[3 * j + 2].alias("hi"), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col(f"{c}_n"))).alias("rank"),
        )
        for c in columns for j, p in enumerate(shares)
    ])
    inside = met.select("g", F.inline(cells)).where(F.col("v").isNotNull() & (F.col("v") <= F.col("hi")))
    counted = inside.groupBy("g", "c", "j", "rank", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("k"))
    ordered = Window.partitionBy("g", "c", "j").orderBy(F.asc_nulls_first("v"))
    reached = counted.withColumn("upto", F.sum("k").over(ordered)).where("upto >= rank")
    found = reached.groupBy("g").pivot("c", list(columns)).agg(*[F.min(F.when(F.col("j") == j, F.col("v"))).alias(f"q{j}") for j in range(len(shares))])
    exact = [F.array(*[F.col(f"{c}_q{j}") for j in range(len(shares))]).alias(f"{c}_q") for c in columns]
    return small.unionByName(large_groups.join(found, "g").select("g", "n", *exact, *ends))


def ideal_point_scores(
    items: DataFrame,
    group: str,
    item: str,
    scores: Sequence[str],
    say: Sequence[float] | None = None,
    winsor: tuple[float, float] = WINSOR,
    ties: bool = False,
) -> DataFrame:
    """``group, item, closeness`` in 0..1: how close each item is to the best value in every score.

    Within a group each score is winsorised at the quantiles ``winsor`` and
    counted from its lowest value, then divided by its Euclidean norm.  The
    ideal point has the highest, the anti-ideal point the lowest value of every
    score.  Distances to both are weighted by ``say`` over the variance of the
    normalised score, so that a score gains nothing from its range nor from
    being spread wider than the others; closeness is the distance to the
    anti-ideal point over the sum of both, to nine decimals.
    Winsorising draws the best items of a large group to one value; with
    ``ties`` a column ``unclipped`` has the closeness of the values as they
    are, by which ``first_places`` and ``ranked`` order items of equal closeness.

    A missing score (null, NaN, infinite or negative) is the lowest of its
    group.  A score that is the same or missing throughout a group has no say
    in it; if that holds for all scores, closeness is 0.5.  Rows with a null
    group or item are left out.  Quantiles are exact at every size; every
    aggregate is combined before the shuffle, and hot groups meet their
    statistics in salted parts, so that a group may hold any share of the rows.
    """
    say = list(say or [1.0] * len(scores))
    n = range(len(scores))
    rows = items.select(
        F.col(group).alias("g"),
        F.col(item).alias("i"),
        *[_usable(s).alias(f"s{k}") for k, s in enumerate(scores)],
    ).where(F.col("g").isNotNull() & F.col("i").isNotNull())
    rows = cut_lineage(rows, "scores")
    bounds = cut_lineage(exact_quantiles(rows, [f"s{k}" for k in n], winsor), "score-bounds")

    def closeness(to_ideal: Column, to_anti: Column) -> Column:
        return F.round(F.when(to_ideal + to_anti > 0, to_anti / (to_ideal + to_anti)).otherwise(0.5), 9)

    def unclipped() -> Column:
        best, worst = [], []
        for k in n:
            low, high = F.col(f"s{k}_min"), F.col(f"s{k}_max")
            share = (F.coalesce(f"s{k}", low) - low) / (high - low)
            for parts, gap in ((best, 1 - share), (worst, share)):
                gap = gap * F.lit(say[k])
                parts.append(F.when(high > low, gap * gap).otherwise(0.0))
        return closeness(*[F.sqrt(reduce(lambda a, b: a + b, parts)) for parts in (best, worst)])

    def winsorised(k: int) -> Column:
        low, high = F.col(f"s{k}_q")[0], F.col(f"s{k}_q")[1]
        return F.coalesce(F.greatest(F.least(F.coalesce(f"s{k}", f"s{k}_min"), high), low) - low, F.lit(0.0))

    drawn = _with_stats(rows, bounds).select(
        "g", "i", *[winsorised(k).alias(f"v{k}") for k in n], *([unclipped().alias("unclipped")] if ties else [])
    )
    moments = drawn.groupBy("g").agg(
        F.count("*").alias("n"),
        *[F.sqrt(F.sum(F.col(f"v{k}") * F.col(f"v{k}"))).alias(f"n{k}") for k in n],
        *[F.var_pop(f"v{k}").alias(f"d{k}") for k in n],
        *[F.max(f"v{k}").alias(f"hi{k}") for k in n],
        *[F.min(f"v{k}").alias(f"lo{k}") for k in n],
    )
    scaled = _with_stats(drawn, cut_lineage(moments, "score-moments"))

    def distance(end: str) -> Column:
        parts = []
        for k in n:
            norm = F.col(f"n{k}")
            variance = F.col(f"d{k}") / (norm * norm)
            gap = (F.col(f"{end}{k}") - F.col(f"v{k}")) / norm * F.lit(say[k]) / variance
            parts.append(F.when(F.col(f"hi{k}") > F.col(f"lo{k}"), gap * gap).otherwise(0.0))
        return F.sqrt(reduce(lambda a, b: a + b, parts))

    to_ideal, to_anti = distance("hi"), distance("lo")
    return scaled.select(
        F.col("g").alias(group),
        F.col("i").alias(item),
        closeness(to_ideal, to_anti).alias("closeness"),
        *(["unclipped"] if ties else []),
    )


def _tie(scored: DataFrame) -> Column:
    return F.col("unclipped") if "unclipped" in scored.columns else F.lit(0.0)


def first_places(scored: DataFrame, group: str, item: str) -> DataFrame:
    """The item in first place of each group; of equals the best by ``unclipped``, then the smallest id.  Combined before the shuffle."""
    return scored.groupBy(group).agg(
        F.min_by(item, F.struct(-F.col("closeness"), -_tie(scored), F.col(item))).alias(item)
    )


def ranked(scored: DataFrame, group: str, item: str) -> DataFrame:
    """Add ``place`` (1 is best, ties by ``unclipped``, then by id) to scored items.

    All rows are cut by range of group and order into partitions, which are
    written once; a row's place is that in its partition and group, and the
    group's rows in the partitions before.  Neither a hot group nor a third of
    all rows of one closeness makes a task larger than its range.
    """
    scored = scored.withColumn("_tie", _tie(scored))
    order = [F.desc("closeness"), F.desc("_tie"), F.col(item)]
    cut = scored.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id())
    cut = cut_lineage(cut, "rank-ranges")
    counts = cut.groupBy("_part", group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part", group).orderBy(*order)
    return (
        cut.join(counts, ["_part", group])
        .withColumn("place", F.row_number().over(within) + F.col("_before"))
        .select(group, item, "closeness", "place")
    )


def clean_path(path: Column, repo: Column) -> Column:
    """A path relative to its repository: slashes, no leading dot, no checkout folder."""
    slashed = F.regexp_replace(path, r"\\", "/")
    root = F.concat(F.lit("/srv/checkouts/"), repo, F.lit("/"))
    inside = F.when(F.startswith(slashed, root), F.substring(slashed, F.length(root) + 1, F.length(slashed)))
    return F.regexp_replace(F.coalesce(inside, slashed), r"^(?:\./+)+", "")


def investigation_scores(hypotheses: DataFrame, research: DataFrame) -> DataFrame:
    """Closeness of every hypothesis of every investigation, over span count, anomaly and its file's fused score.

    The latest report of a hypothesis and the latest score of a file hold;
    files written in several ways are brought to one form.  Both inputs are
    combined by key before they are joined; the join is on investigation and
    path, which no hot investigation makes large.
    """
    latest = hypotheses.groupBy("investigation_id", "hyp_id").agg(
        F.max_by(
            F.struct(
                "span_count", "anomaly_score", clean_path(F.col("file"), F.col("repo_key")).alias("rel_path")
            ),
            F.struct("reported_at", "span_count", "anomaly_score"),
        ).alias("h")
    )
    latest = latest.select("investigation_id", "hyp_id", "h.*")
    fused = research.groupBy("investigation_id", "rel_path").agg(
        F.max(F.struct("scored_at", "fused_score")).alias("f")
    )
    joined = latest.join(
        fused.select("investigation_id", "rel_path", "f.fused_score"), ["investigation_id", "rel_path"], "left"
    )
    return ideal_point_scores(
        joined, "investigation_id", "hyp_id", ["span_count", "anomaly_score", "fused_score"], ties=True
    )
