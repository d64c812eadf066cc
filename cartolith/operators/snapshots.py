"""What changed between consecutive full snapshots of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.session import broadcast_if_bounded, cut_lineage


def row_hash(*columns: Column) -> Column:
    """A 64-bit hash that tells null from empty and keeps positions apart."""
    parts: list[Column] = []
    for column in columns:
        parts += [column.isNull(), F.coalesce(column.cast("string"), F.lit(""))]
    return F.xxhash64(*parts)


def next_in_order(headers: DataFrame, key: str, at: str, row_id: str) -> DataFrame:
    """Add ``prev_id`` and ``next_id``: the neighbours of each row in (at, row_id) order within ``key``.

    The order is cut by calendar day, so that a hot key is ordered by as many
    tasks as it has days; a second window over the days' first and last rows
    (bounded by the calendar) joins the ends together.
    """
    day = F.to_date(at)
    df = headers.withColumn("_day", day)
    inner = Window.partitionBy(key, "_day").orderBy(at, row_id)
    df = df.withColumns({"_p": F.lag(row_id).over(inner), "_n": F.lead(row_id).over(inner)})
    ends = df.groupBy(key, "_day").agg(
        F.min(F.when(F.col("_p").isNull(), F.col(row_id))).alias("_first"),
        F.max(F.when(F.col("_n").isNull(), F.col(row_id))).alias("_last"),
    )
    outer = Window.partitionBy(key).orderBy("_day")
    ends = ends.select(
        key, "_day", F.lag("_last").over(outer).alias("_before"), F.lead("_first").over(outer).alias("_after")
    )
    return df.join(ends, [key, "_day"]).select(
        *headers.columns,
        F.coalesce("_p", "_before").alias("prev_id"),
        F.coalesce("_n", "_after").alias("next_id"),
    )


def valid_snapshots(snapshots: DataFrame) -> DataFrame:
    """One row per valid snapshot: the delivery that holds and its neighbours in time.

    A run with neither symbols nor edges has failed and is passed over; of
    several deliveries of a snapshot the one received last holds.
    """
    held = (
        snapshots.where(
            F.col("snapshot_id").isNotNull()
            & F.col("snapshot_at").isNotNull()
            & (F.col("symbols").isNotNull() | F.col("edges").isNotNull())
        )
        .groupBy("snapshot_id")
        .agg(F.max(F.struct("received_at", "snapshot_at", "repo_key")).alias("h"))
        .select("snapshot_id", "h.repo_key", "h.snapshot_at", "h.received_at")
    )
    return next_in_order(held, "repo_key", "snapshot_at", "snapshot_id")


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """Symbols added, removed or changed and edges added or removed, per pair of consecutive snapshots.

    Both snapshots of a pair are unioned, tagged by side (a snapshot is the new
    side of its own pair and the old side of the next one), grouped by key and
    classified from one hash per side; elements are shuffled once.

    Input columns used: ``snapshot_id, repo_key, snapshot_at, received_at,
    symbols, edges``; all others are ignored, whatever their names.

    Defined cases: an empty table gives no rows; a null ``symbols`` or
    ``edges`` beside the other one not null is an empty list; null elements are
    ignored; null parts of a key are empty strings; complexity null is 0; a
    snapshot without ``snapshot_id`` or ``snapshot_at`` is ignored; rows
    repeated whole change nothing; of a key repeated within an array the last
    element holds; snapshots of the same instant are ordered by id.  A null
    ``repo_key`` is a repository of its own, the rows of which have no
    neighbours.
    """
    links = cut_lineage(
        valid_snapshots(snapshots).where(F.col("prev_id").isNotNull() | F.col("next_id").isNotNull()), "snapshot-links"
    ).select(
        "snapshot_id",
        F.coalesce("received_at", F.lit(0).cast("timestamp")).alias("received_at"),
        "prev_id",
        "next_id",
    )

    def key(separator: str, *fields: Column) -> Column:
        return F.concat_ws(separator, *[F.coalesce(f, F.lit("")) for f in fields])

    symbols = F.transform(
        F.coalesce("symbols", F.array()),
        lambda s, i: F.struct(
            F.lit("symbol").alias("item"),
            key(":", s["n"], s["f"]).alias("item_key"),
            i.alias("pos"),
            row_hash(s["k"], s["c"], F.coalesce(s["x"], F.lit(0))).alias("hash"),
            s.isNull().alias("void"),
        ),
    )
    edges = F.transform(
        F.coalesce("edges", F.array()),
        lambda e, i: F.struct(
            F.lit("edge").alias("item"),
            key("|", e["s"], e["l"], e["t"]).alias("item_key"),
            i.alias("pos"),
            F.lit(0).cast("bigint").alias("hash"),
            e.isNull().alias("void"),
        ),
    )
    facts = snapshots.where(F.col("symbols").isNotNull() | F.col("edges").isNotNull()).select(
        "snapshot_id", F.coalesce("received_at", F.lit(0).cast("timestamp")).alias("received_at"), "symbols", "edges"
    )
    held = facts.join(broadcast_if_bounded(links), ["snapshot_id", "received_at"])
    elements = held.select(
        F.when(F.col("prev_id").isNotNull(), F.col("snapshot_id")).alias("as_new"),
        F.col("next_id").alias("as_old"),
        F.explode(F.concat(symbols, edges)).alias("e"),
    ).where(~F.col("e.void"))
    sides = elements.select(
        F.explode(
            F.array(
                F.struct(F.col("as_new").alias("snapshot_id"), F.lit(1).alias("side")),
                F.struct(F.col("as_old").alias("snapshot_id"), F.lit(0).alias("side")),
            )
        ).alias("t"),
        "e.*",
    ).where(F.col("t.snapshot_id").isNotNull())
    old, new = F.col("t.side") == 0, F.col("t.side") == 1
    paired = sides.groupBy(F.col("t.snapshot_id").alias("snapshot_id"), "item", "item_key").agg(
        F.max_by("hash", F.when(old, F.col("pos"))).alias("was"),
        F.max_by("hash", F.when(new, F.col("pos"))).alias("now"),
        F.max(F.when(old, 1)).alias("had"),
        F.max(F.when(new, 1)).alias("has"),
    )
    change = (
        F.when(F.col("had").isNull(), "added")
        .when(F.col("has").isNull(), "removed")
        .when(F.col("was") != F.col("now"), "changed")
    )
    return paired.withColumn("change", change).where(F.col("change").isNotNull()).select(
        "snapshot_id", "item", "item_key", "change"
    )
