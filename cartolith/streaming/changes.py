"""Structured Streaming counterparts of watching, debouncing and incremental indexing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartolith.session import cut_lineage
from cartolith.sources.sinks import replace_partitions


def debounced(changes: DataFrame, gap: str = "500 milliseconds", lateness: str = "10 seconds") -> DataFrame:
    """``path, started, ended, changes, last_hash``: bursts of changes (path, ts, hash) to a path, once they are over."""
    return (
        changes.withWatermark("ts", lateness)
        .groupBy("path", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("changes"), F.max_by("hash", "ts").alias("last_hash"))
        .select("path", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "changes", "last_hash")
    )


def tumbling_counts(events: DataFrame, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Events (key, ts) per key and epoch-aligned window; late rows beyond the watermark are dropped by the engine."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy("key", F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("events"))
        .select("key", F.col("w.start").alias("started"), "events")
    )


def first_deliveries(rows: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """Rows (with ts) delivered again within the watermark are dropped."""
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def upserted(stored: DataFrame, batch: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """The stored rows with a batch of newer ones laid over them; of each key the row with the latest ``newest`` holds.

    Both sides are aggregated by key in one exchange, rather than joined.
    """
    rest = [c for c in stored.columns if c not in keys]
    both = stored.unionByName(batch.select(*stored.columns))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(newest)).alias("v")).select(*keys, "v.*")


def removed(stored: DataFrame, seen: DataFrame, keys: list[str], least_share: float = 0.7) -> DataFrame:
    """Stored keys that were not seen; none if less than ``least_share`` of them was seen (a broken scan)."""
    gone = stored.select(*keys).distinct().join(seen.select(*keys).distinct(), keys, "left_anti")
    counts = stored.select(*keys).distinct().agg(F.count("*").alias("_all")).crossJoin(
        seen.select(*keys).distinct().agg(F.count("*").alias("_seen"))
    )  # one row
    return gone.crossJoin(F.broadcast(counts)).where(F.col("_seen") >= least_share * F.col("_all")).select(*keys)


#: Parts of a table that a stream keeps up to date; a batch rewrites those it touches.
PARTS = 64


def incremental_index(
    changes: DataFrame, path: str, checkpoint: str, index: Callable[[DataFrame], DataFrame], keys: list[str], newest: str, parts: int = PARTS
) -> StreamingQuery:
    """Keep a table at ``path`` up to date from a stream: each batch is indexed and laid over the table.

    Rows lie in ``parts`` partitions by a hash of their key (column ``part``).
    A batch reads and replaces those it touches; of each key the newest row
    holds, so that a batch that is run again after a failure gives the same table.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = cut_lineage(index(batch).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")), "stream-batch")
        touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most ``parts``
        if not touched:
            return
        if exists(spark, path):
            stored = spark.read.parquet(path).where(F.col("part").isin(*touched)).select(*new.columns)
            new = cut_lineage(upserted(stored, new, [*keys, "part"], newest), "stream-merged")
        else:
            new = upserted(new.limit(0), new, [*keys, "part"], newest)
        replace_partitions(new, path, "part")

    return (
        changes.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written at ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def file_changes(stored: DataFrame, current: DataFrame, files: DataFrame) -> DataFrame:
    """``repo, file, name, action``: what an index of symbols has to do about them.

    ``stored`` and ``current``: repo, file, name, hash; ``files``: repo, file,
    usable.  Symbols of files that are gone or not usable (tests, oversize) are
    removed, as are those their file no longer has; new ones and those of
    another hash are indexed; a hash of 0 is none and never equal.
    """
    keys = ["repo", "file", "name"]
    known = files.where("usable").select("repo", "file").distinct()
    old = stored.groupBy(*keys).agg(F.max("hash").alias("was"), F.lit(1).alias("had"))
    new = current.join(known, ["repo", "file"], "left_semi").groupBy(*keys).agg(F.max("hash").alias("now"), F.lit(1).alias("has"))
    same = (F.col("was") == F.col("now")) & (F.col("now") != 0)
    action = F.when(F.col("has").isNull(), "remove").when(F.col("had").isNull(), "add").when(~F.coalesce(same, F.lit(False)), "update")
    return old.join(new, keys, "full_outer").select(*keys, action.alias("action")).where(F.col("action").isNotNull())


def webhook_signature(body: Column, secret: str) -> Column:
    """The signature that a delivery's sender gives: HMAC of its bytes by SHA-256, as ``sha256=`` and hexadecimal digits."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in key)) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256)
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, F.unhex(digest)), 256))


def signed_deliveries(events: DataFrame, secret: str) -> DataFrame:
    """Deliveries (json, signature) whose signature is right; one without any is not."""
    return events.where(F.coalesce(F.col("signature") == webhook_signature(F.col("json"), secret), F.lit(False)))


def webhook_pushes(events: DataFrame, actions: tuple[str, ...] = ("opened", "synchronize", "reopened")) -> DataFrame:
    """``repo, action, number, sender`` of JSON deliveries (column ``json``) with one of ``actions``, bots left out."""
    schema = "action string, number bigint, repository struct<full_name: string>, sender struct<login: string, type: string>"
    event = F.from_json("json", schema)
    rows = events.select(
        event["repository"]["full_name"].alias("repo"), event["action"].alias("action"), event["number"].alias("number"),
        event["sender"]["login"].alias("sender"), event["sender"]["type"].alias("type"),
    )
    return rows.where(F.col("action").isin(*actions) & (F.col("type") != "Bot") & ~F.col("sender").endswith("[bot]")).drop("type")
