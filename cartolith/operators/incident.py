"""Incident analytics: a window of metrics against a baseline, hypotheses, versions in a fleet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import stats


def _parts(start: Column, end: Column, gap: str = "1 HOUR") -> tuple[Column, Column]:
    """Conditions on ts: inside the window, and inside a baseline of the same length that ends ``gap`` before it."""
    ts = F.col("ts")
    length = F.unix_timestamp(end) - F.unix_timestamp(start)
    before = F.unix_timestamp(start) - F.expr(f"CAST(INTERVAL {gap} AS INTERVAL SECOND)").cast("bigint")
    at = F.unix_timestamp(ts)
    return (ts >= start) & (ts < end), (at >= before - length) & (at < before)


def _spike(samples: DataFrame, value: Column, start: Column, end: Column, steps: list[tuple[float, float]], low: float, empty: float | None) -> DataFrame:
    inside, before = _parts(start, end)
    rolled = samples.groupBy("metric").agg(
        value(inside).alias("window_value"), value(before).alias("baseline_value")
    ).where(F.col("window_value").isNotNull())
    ratio = F.col("window_value") / F.col("baseline_value")
    score = reduce(lambda c, s: c.when(ratio > s[0], s[1]), steps[1:], F.when(ratio > steps[0][0], steps[0][1])).otherwise(low)
    if empty is not None:
        score = F.when(F.col("baseline_value").isNull() | (F.col("baseline_value") == 0), empty).otherwise(score)
    return rolled.select(
        "metric", F.round("window_value", 6).alias("window_value"), F.round("baseline_value", 6).alias("baseline_value"),
        F.round(ratio, 6).alias("ratio"), score.alias("score"),
    )


def failure_spikes(samples: DataFrame, start: Column, end: Column) -> DataFrame:
    """Greatest value in the window against the baseline; ``samples``: metric, ts, value."""
    return _spike(
        samples, lambda c: F.max(F.when(c, F.col("value").cast("double"))), start, end, [(5, 1.0), (2, 0.8), (1.2, 0.6)], 0.3, 0.7
    )


def latency_spikes(samples: DataFrame, start: Column, end: Column) -> DataFrame:
    """99th percentile (nearest rank) in the window against the baseline; exact, over value counts."""
    inside, before = _parts(start, end)
    tagged = samples.select("metric", F.col("value").cast("double").alias("value"), F.when(inside, 1).when(before, 0).alias("side")).where("side IS NOT NULL")
    counts = tagged.groupBy("metric", "side", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("metric", "side").orderBy("value")
    whole = Window.partitionBy("metric", "side")
    at = counts.withColumns({"run": F.sum("n").over(order), "total": F.sum("n").over(whole)})
    p99 = at.where(F.col("run") >= F.ceil(0.99 * F.col("total"))).groupBy("metric").agg(
        F.min(F.when(F.col("side") == 1, F.col("value"))).alias("window_value"),
        F.min(F.when(F.col("side") == 0, F.col("value"))).alias("baseline_value"),
    ).where(F.col("window_value").isNotNull())
    ratio = F.col("window_value") / F.col("baseline_value")
    score = F.when(ratio > 2, 0.9).when(ratio > 1.5, 0.7).otherwise(0.3)
    return p99.select("metric", "window_value", "baseline_value", F.round(ratio, 6).alias("ratio"), score.alias("score"))


def saturation_spikes(samples: DataFrame, start: Column, end: Column) -> DataFrame:
    """Greatest gauge value in the window against the baseline with the wider steps of gauges."""
    return _spike(
        samples, lambda c: F.max(F.when(c, F.col("value").cast("double"))), start, end, [(5, 1.0), (2, 0.8), (1.3, 0.6)], 0.3, None
    )


def ranked_spikes(spikes: DataFrame, k: int | None = None) -> DataFrame:
    """Spikes by score; ties by metric."""
    found = spikes.orderBy(F.desc("score"), "metric")
    return found if k is None else found.limit(k)


def fused_hypotheses(items: DataFrame, weights: dict[str, float], group: str, item: str) -> DataFrame:
    """Weighted sum of min-max scaled signals within a group, missing signals as 0.

    The range of a group is aggregated before the shuffle and joined back.
    """
    rows = items.select(
        group, item, *[F.coalesce(F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")), F.lit(0.0)).alias(s) for s in weights]
    )
    ranges = rows.groupBy(group).agg(
        *[f(s).alias(f"_{n}_{s}") for s in weights for n, f in (("low", F.min), ("high", F.max))]
    )
    score = reduce(
        lambda a, b: a + b,
        [w * stats.min_max(F.col(s), F.col(f"_low_{s}"), F.col(f"_high_{s}")) for s, w in weights.items()],
    )
    return rows.join(ranges, group).select(group, item, F.round(score, 6).alias("score"))


def operation_function(operation: Column) -> Column:
    """Function name that a traced operation stands for: method of an RPC path, verb plus last word of a route, method value."""
    rpc = F.regexp_extract(operation, r"^/?[\w.]+/(\w+)$", 1)
    verb = F.lower(F.regexp_extract(operation, r"^(GET|POST|PUT|PATCH|DELETE|HEAD)\s", 1))
    last = F.regexp_extract(F.regexp_replace(operation, r"/(?:\{[^}]*\}|:\w+|\*|\d+)(?=/|$)", ""), r"/(\w+)/?$", 1)
    value = F.regexp_extract(operation, r"\(?\*?[\w./]*\)?\.(\w+)(?:-fm)?$", 1)
    return (
        F.when(verb != "", F.concat(verb, F.initcap(last)))
        .when(rpc != "", rpc)
        .when(value != "", value)
        .otherwise(operation)
    )


def spans_by_operation(spans: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """Count of spans and the first non-empty value of each tag, by start order; ``spans``: operation, seq, tags."""
    def first(tag: str) -> Column:
        value = F.nullif(F.col("tags")[tag], F.lit(""))
        return F.min_by(value, F.when(value.isNotNull(), F.col("seq"))).alias(tag)

    return spans.groupBy("operation").agg(F.count("*").alias("spans"), *[first(t) for t in tags])


def fleet_drift(pinned: DataFrame, runtime: DataFrame) -> DataFrame:
    """Pinned against running tags of each image, i-th with i-th in order of tag.

    ``pinned``: image, tag; ``runtime``: image, tag.  Tags are counted first, so
    that an image that runs a million times is a few rows; runs of equal tags
    are matched as intervals of places.
    """
    def runs(df: DataFrame, side: str) -> DataFrame:
        counts = df.groupBy("image", "tag").agg(F.count("*").alias("n"))
        order = Window.partitionBy("image").orderBy("tag")
        end = F.sum("n").over(order)
        return counts.select("image", F.col("tag").alias(f"{side}_tag"), (end - F.col("n")).alias(f"{side}_start"), end.alias(f"{side}_end"))

    a, b = runs(pinned, "source"), runs(runtime, "live")
    met = a.join(b, "image").select(
        "image", "source_tag", "live_tag",
        (F.least("source_end", "live_end") - F.greatest("source_start", "live_start")).alias("n"),
    ).where("n > 0")
    totals = a.groupBy("image").agg(F.max("source_end").alias("source_total")).join(
        b.groupBy("image").agg(F.max("live_end").alias("live_total")), "image", "full_outer"
    ).na.fill(0)
    def rest(runs_of: DataFrame, side: str, other: str) -> DataFrame:
        left = runs_of.join(totals.select("image", f"{other}_total"), "image").select(
            "image", F.col(f"{side}_tag"),
            (F.col(f"{side}_end") - F.greatest(f"{side}_start", F.least(f"{side}_end", f"{other}_total"))).alias("n"),
        ).where("n > 0")
        return left
    status = F.when(F.col("source_tag") == F.col("live_tag"), "same").otherwise("drift")
    return (
        met.select("image", "source_tag", "live_tag", status.alias("status"), "n")
        .unionByName(rest(a, "source", "live").select("image", "source_tag", F.lit(None).cast("string").alias("live_tag"), F.lit("only_source").alias("status"), "n"))
        .unionByName(rest(b, "live", "source").select("image", F.lit(None).cast("string").alias("source_tag"), "live_tag", F.lit("only_runtime").alias("status"), "n"))
    )


def sibling_drift(runtime: DataFrame) -> DataFrame:
    """Images that run with more than one tag: number of tags and one representative container each (the smallest)."""
    return runtime.groupBy("image").agg(
        F.count_distinct("tag").alias("tags"), F.min("container").alias("container")
    ).where("tags > 1")


#: Order in which drifts are shown.
STATUS_ORDER = ("drift", "only_source", "only_runtime", "same")


def by_status(drift: DataFrame) -> DataFrame:
    """Add ``place``: rows of ``fleet_drift`` of each image group in the order of their status, then by image and tags."""
    rank = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status"))
    order = Window.partitionBy(F.substring_index("image", "/", 1)).orderBy(rank, "image", "source_tag", "live_tag")
    return drift.withColumn("place", F.row_number().over(order))


def latest_notes(notes: DataFrame, k: int = 3) -> DataFrame:
    """The newest k notes (repo, symbol, id, at) of each symbol of a repository; ties by id."""
    order = Window.partitionBy("repo", "symbol").orderBy(F.desc("at"), F.desc("id"))
    return notes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def metrics_like(samples: DataFrame, pattern: str) -> DataFrame:
    """``metric, samples``: metrics whose name matches a pattern."""
    return samples.where(F.col("metric").rlike(pattern)).groupBy("metric").agg(F.count("*").alias("samples"))


def repository_hits(hits: DataFrame, repositories: DataFrame, least_stars: int, most: int | None = None) -> DataFrame:
    """Hits (name, place) of repositories (name, stars) with enough stars, each name once in any case, the first in order."""
    own = repositories.groupBy(F.lower("name").alias("_key")).agg(F.max("stars").alias("stars")).where(F.col("stars") >= least_stars)
    first = hits.groupBy(F.lower("name").alias("_key")).agg(F.min_by(F.struct("name", "place"), F.struct("place", "name")).alias("v"))
    found = first.join(own, "_key").select("v.name", "stars", "v.place")
    return found if most is None else found.orderBy("place", "name").limit(most)
