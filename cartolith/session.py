"""Session defaults and the few cluster-aware helpers the operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def build_session(app: str = "cartolith", master: str | None = None, **conf: object) -> SparkSession:
    """A session with UTC, adaptive execution and skew handling switched on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per context, so that Python operators load there."""
    context = spark.sparkContext
    if getattr(context, "_cartolith_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="cartolith-package-"), "cartolith.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in (n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                archive.write(full, os.path.join("cartolith", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._cartolith_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir`` (shared storage on a cluster).

    Only where that is unset on a local master, as in tests, a temporary folder
    is made and set; on a cluster it has to be named, as its machines see no
    common temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cartolith-ckpt-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and go on from there.

    Unlike shuffle files the table survives the loss of executors; unlike a
    row checkpoint it is compressed and lets later reads prune columns.  The
    tables of a session lie below one folder, which ``remove_staged`` removes.
    """
    spark = df.sparkSession
    path = f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/cartolith-{spark.sparkContext.applicationId}"


def remove_staged(spark: SparkSession) -> bool:
    """Remove all tables that ``cut_lineage`` wrote in this session; results that still read them must have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when ``df`` is known to have at most ``max_rows`` rows and ``max_bytes`` bytes.

    ``df`` should be cheap to read again (a checkpoint or a written table): it
    is measured up to the bound, a row by the length of its JSON text, which is
    no shorter than its values.  Beyond the bound the join is left to shuffle.
    """
    size = F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), size).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one Parquet table; wall-clock timestamps without zone are taken as UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    casts = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df
