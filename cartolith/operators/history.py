"""Analytics over commits, touches and files: churn, co-change, hotspots, reviewers, health."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import stats
from cartolith.session import broadcast_if_bounded, cut_lineage, ship_package

#: Files, and touched buckets of these, of one part; each two parts are counted against each other.
BUCKET_PART, PART_TOUCHES = 32_768, 2_000_000
#: Pairs that a task gives out at a time.
PAIRS_OUT = 200_000
#: A file's hits are sorted if they are fewer than this share of the other part's files, else counted by place.
SPARSE = 16


def churn(commits: DataFrame) -> DataFrame:
    """``path, commits, additions, deletions, score``: distinct commits plus a hundredth of the changed lines."""
    rolled = commits.groupBy("path").agg(
        F.count_distinct("commit_id").alias("commits"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
    )
    return rolled.withColumn("score", F.round(F.col("commits") + (F.col("additions") + F.col("deletions")) / 100.0, 6))


def cumulative_share(df: DataFrame, value: str, alias: str) -> DataFrame:
    """Add the share of rows with at most this value (``cume_dist``) without one task for all rows.

    Values are counted first (map-side) and cut by range into partitions, which
    are written once; the running total goes over the distinct values of a
    partition, and the partitions' sums, a row each, are added up.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    spread = cut_lineage(counts.repartitionByRange(value).withColumn("_part", F.spark_partition_id()), "value-ranges")
    sums = spread.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    before = sums.select(
        "_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy(F.lit(1))).alias("_all")
    )  # one row a partition
    within = Window.partitionBy("_part").orderBy(value)
    shares = spread.withColumn("_run", F.sum("_n").over(within)).join(F.broadcast(before), "_part").select(
        value, ((F.col("_before") + F.col("_run")) / F.col("_all")).alias(alias)
    )
    return df.join(shares, value)


def hotspots(churned: DataFrame, complexity: DataFrame, limit: int | None = 20) -> DataFrame:
    """Files by the product of the cumulative shares of churn and complexity, with a band.

    ``churned``: path, score; ``complexity``: path, complexity.
    """
    both = churned.join(complexity, "path").select("path", "score", "complexity")
    shared = cumulative_share(cumulative_share(both, "score", "churn_share"), "complexity", "complexity_share")
    product = F.col("churn_share") * F.col("complexity_share")
    band = F.when(product >= 0.81, "critical").when(product >= 0.64, "high").when(product >= 0.36, "medium").otherwise("low")
    found = shared.select("path", F.round(product, 9).alias("hotspot"), band.alias("band"))
    return found if limit is None else found.orderBy(F.desc("hotspot"), "path").limit(limit)


def coupled_files(commits: DataFrame, least: int = 2, most: int = 20, limit: int | None = 20) -> DataFrame:
    """Pairs of files changed together in commits of ``least`` to ``most`` files: count and share of the busier file's commits.

    The bound on a commit's files bounds the pairs it gives; larger commits
    (imports, reformatting) say nothing about coupling and count for the files' totals only.
    """
    touched = commits.select("commit_id", "path").distinct()
    totals = touched.groupBy("path").agg(F.count("*").alias("n"))
    sized = touched.groupBy("commit_id").agg(F.count("*").alias("files")).where(F.col("files").between(least, most))
    own = touched.join(sized.select("commit_id"), "commit_id")
    pairs = own.join(own.withColumnRenamed("path", "other"), "commit_id").where(F.col("path") < F.col("other"))
    counted = pairs.groupBy("path", "other").agg(F.count("*").alias("together"))
    found = counted.join(totals, "path").join(
        totals.select(F.col("path").alias("other"), F.col("n").alias("m")), "other"
    )
    found = found.select(
        "path", "other", "together", F.round(F.col("together") / F.greatest("n", "m"), 6).alias("ratio")
    )
    return found if limit is None else found.orderBy(F.desc("together"), F.desc("ratio"), "path", "other").limit(limit)


def window_cochange(
    touches: DataFrame, window: int = 3600, least: int = 3, ubiquity: float = 0.85
) -> DataFrame:
    """Files of different repositories touched in the same time buckets, with lift, Wilson bound and G squared.

    ``touches``: repo, file, ts.  Files in more than ``ubiquity`` of the
    buckets are left out, as they go with everything; files in fewer than
    ``least`` cannot make a pair.  Common buckets grow with the square of a
    bucket's files and are never rows: files are cut into parts by repository
    and name, and each two parts are counted in one task from their files'
    lists of buckets, so that a file travels once for each part.
    """
    bucketed = touches.select(
        F.floor(F.unix_timestamp("ts") / window).alias("bucket"), "repo", "file"
    ).distinct()
    bucketed = cut_lineage(bucketed, "touch-buckets")
    n = bucketed.agg(F.count_distinct("bucket")).first()[0]
    counts = bucketed.groupBy("repo", "file").agg(F.count("*").alias("k"), F.collect_list("bucket").alias("buckets"))
    kept = counts.where(F.col("k").between(least, ubiquity * F.lit(n)) & F.col("repo").isNotNull() & F.col("file").isNotNull())
    kept = cut_lineage(kept, "touch-files")
    counted = _counted_pairs(kept, least)
    co, a, b = (F.col(c).cast("double") for c in ("co", "a", "b"))
    total = F.lit(float(n))
    g2 = stats.log_likelihood(co, a, b, total)
    scored = counted.select(
        "pairs", "co",
        F.round(stats.lift(co, a, b, total), 6).alias("lift"),
        F.round(stats.wilson_lower(co, F.least(a, b)), 6).alias("confidence"),
        F.round(g2, 4).alias("g2"),
        stats.significance(F.round(g2, 4)).alias("label"),
    )
    return scored.select(F.inline("pairs"), "co", "lift", "confidence", "g2", "label")


def _counted_pairs(kept: DataFrame, least: int) -> DataFrame:
    """``a, b, co, pairs`` of all files of two repositories with ``least`` buckets in common.

    ``kept``: repo, file, k, buckets; staged.  A task's pairs with equal counts
    share a row, so that their measures are computed once.
    """
    ship_package(kept.sparkSession)
    files, touched = kept.agg(F.count("*"), F.coalesce(F.sum(F.size("buckets")), F.lit(0))).first()
    parts = max(1, -(-files // BUCKET_PART), -(-touched // PART_TOUCHES))
    cut = cut_lineage(kept.repartitionByRange(parts, "repo", "file").withColumn("part", F.spark_partition_id()), "touch-parts")
    spans = cut.groupBy("part").agg(F.min("repo").alias("first"), F.max("repo").alias("last"))
    meets = spans.select(F.col("part").alias("left"), "first", F.explode(F.sequence("part", F.lit(parts - 1))).alias("right")).join(
        spans.select(F.col("part").alias("right"), "last"), "right"
    )
    meets = cut_lineage(meets.where(F.col("first") < F.col("last")).select("left", "right"), "touch-meets")
    held = broadcast_if_bounded(meets)
    mine = cut.join(held, F.col("part") == F.col("left")).withColumn("side", F.lit(0))
    theirs = cut.join(held.where(F.col("left") < F.col("right")), F.col("part") == F.col("right")).withColumn("side", F.lit(1))
    columns = ["left", "right", "side", "repo", "file", "k", "buckets"]
    both = mine.select(columns).unionByName(theirs.select(columns))
    tasks = max(1, 2 * meets.count())  # by number, as these rows are few but dear
    return both.repartition(tasks, "left", "right").groupBy("left", "right").applyInArrow(
        _common_buckets(least), "a bigint, b bigint, co bigint, pairs array<struct<repo_a: string, file_a: string, repo_b: string, file_b: string>>"
    )


def _common_buckets(least: int):
    """Counts the buckets that files of side 0 share with files of later repositories of side 1, or of side 0 if there is no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        mine, theirs = (table.filter(pc.equal(table["side"], side)).sort_by([("repo", "ascending"), ("file", "ascending")]).combine_chunks() for side in (0, 1))
        theirs = theirs if theirs.num_rows else mine
        width, repos = theirs.num_rows, theirs["repo"].to_pylist()
        after = {repo: bisect.bisect_right(repos, repo) for repo in mine["repo"].unique().to_pylist()}
        times, at = np.unique(_flat(theirs)[0], return_inverse=True)
        order = np.argsort(at, kind="stable")
        owners = np.repeat(np.arange(width), np.diff(_flat(theirs)[1]))[order]
        touching = np.split(owners, np.cumsum(np.bincount(at, minlength=len(times)))[:-1])
        own, ends = _flat(mine)
        known = np.isin(own, times)
        ends = np.append(0, np.cumsum(known))[ends].tolist()
        place = np.searchsorted(times, own[known]).tolist()
        found, size = [], 0
        for k, repo in enumerate(mine["repo"].to_pylist()):
            if ends[k + 1] - ends[k] < least or after[repo] == width:
                continue
            hits = np.concatenate([touching[p] for p in place[ends[k] : ends[k + 1]]])
            if SPARSE * len(hits) < width:
                other, co = np.unique(hits, return_counts=True)
                held = (co >= least) & (other >= after[repo])
                other, co = other[held], co[held]
            else:
                counts = np.bincount(hits, minlength=width)
                other = after[repo] + np.flatnonzero(counts[after[repo] :] >= least)
                co = counts[other]
            if len(other):
                found.append((np.full(len(other), k), other, co))
                size += len(other)
            if size >= PAIRS_OUT:
                yield _named(mine, theirs, found)
                found, size = [], 0
        if found:
            yield _named(mine, theirs, found)

    return run


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a table's files one after the other, and where each file's begin and the last one's end."""
    sizes = np.append(0, pc.list_value_length(table["buckets"]).to_numpy())
    return pc.list_flatten(table["buckets"]).to_numpy(), np.cumsum(sizes)


def _named(mine: pa.Table, theirs: pa.Table, found: list) -> pa.RecordBatch:
    left, right, co = (np.concatenate(x) for x in zip(*found))
    a, b = mine["k"].to_numpy()[left], theirs["k"].to_numpy()[right]
    order = np.lexsort((co, b, a))
    left, right, a, b, co = (x[order] for x in (left, right, a, b, co))
    first = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(co) != 0)))
    names = [t[c].take(pa.array(x)).combine_chunks() for t, x in ((mine, left), (theirs, right)) for c in ("repo", "file")]
    pairs = pa.ListArray.from_arrays(pa.array(np.append(first, len(co)), pa.int32()), pa.StructArray.from_arrays(names, ["repo_a", "file_a", "repo_b", "file_b"]))
    return pa.RecordBatch.from_arrays([*(pa.array(x[first]) for x in (a, b, co)), pairs], ["a", "b", "co", "pairs"])


def reviewers(commits: DataFrame, partners: DataFrame, as_of: Column, days: int = 90, most: int = 5) -> DataFrame:
    """Authors to ask about each file: 1 a commit to it, 0.5 a commit to a partner file, 0.4 a commit of the last days.

    ``partners``: path, other (both directions).  The best ``most`` of each
    file; the limit is applied before the shuffle as well.
    """
    own = commits.select("path", "author", "commit_id", "ts").distinct()
    recent = F.count_if(F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    authors = cut_lineage(own.groupBy("path", "author").agg(F.count("*").alias("n"), recent.alias("recent")), "file-authors")
    signals = authors.select("path", "author", (F.col("n") + 0.4 * F.col("recent")).alias("w")).unionByName(
        partners.join(authors.select(F.col("path").alias("other"), "author", "n"), "other").select("path", "author", (0.5 * F.col("n")).alias("w"))
    )
    scored = signals.groupBy("path", "author").agg(F.round(F.sum("w"), 6).alias("score"))
    order = Window.partitionBy("path").orderBy(F.desc("score"), "author")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def file_health(commits: DataFrame) -> DataFrame:
    """Health 1 to 10 of each path: 1 + 9 (0.6 defect + 0.4 churn), from fixing commits and relative churn."""
    rolled = commits.groupBy("path").agg(
        F.count_distinct(F.when(F.col("is_fix"), F.col("commit_id"))).alias("fixes"),
        F.count_distinct("commit_id").alias("commits"),
        (F.sum("additions") + F.sum("deletions")).alias("changed"),
        F.sum("additions").alias("size"),
    )
    defect = stats.clamp(F.log1p(F.col("fixes").cast("double")) / F.log1p(F.lit(20.0)))
    relative = F.col("changed") / F.greatest("size", F.lit(1)) / 2
    churned = F.when(relative < 0.1, 0.0).otherwise(stats.clamp(relative))
    return rolled.select(
        "path", "fixes", "commits", F.round(1 + F.round(9 * (0.6 * defect + 0.4 * churned), 6)).cast("int").alias("health")
    )


def recent_commits(commits: DataFrame, n: int = 20) -> DataFrame:
    """The newest commits with their number of files."""
    rolled = commits.groupBy("commit_id", "author", "ts").agg(F.count_distinct("path").alias("files"))
    return rolled.orderBy(F.desc("ts"), F.desc("commit_id")).limit(n)


def changed_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """``repo, path, change`` between two tables of (repo, path, mod_time): new, changed or removed files."""
    joined = stored.select("repo", "path", F.col("mod_time").alias("was"), F.lit(1).alias("had")).join(
        current.select("repo", "path", F.col("mod_time").alias("now"), F.lit(1).alias("has")), ["repo", "path"], "full_outer"
    )
    change = (
        F.when(F.col("had").isNull(), "new")
        .when(F.col("has").isNull(), "removed")
        .when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    )
    return joined.select("repo", "path", change.alias("change")).where(F.col("change").isNotNull())


def newest_snapshots(snapshots: DataFrame, keep: int = 5) -> DataFrame:
    """Ids of the newest ``keep`` snapshots of each repository; the limit goes before the shuffle too."""
    order = Window.partitionBy("repo_key").orderBy(F.desc("snapshot_at"), F.desc("snapshot_id"))
    return (
        snapshots.select("repo_key", "snapshot_id", "snapshot_at").distinct()
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
        .select("repo_key", "snapshot_id", "place")
    )


def graph_summary(changes: DataFrame) -> DataFrame:
    """Counts of each kind of change per snapshot."""
    return changes.groupBy("snapshot_id").agg(
        *[
            F.count_if((F.col("item") == item) & (F.col("change") == change)).alias(f"{item}s_{change}")
            for item, change in (
                ("symbol", "added"), ("symbol", "removed"), ("symbol", "changed"), ("edge", "added"), ("edge", "removed"),
            )
        ]
    )
