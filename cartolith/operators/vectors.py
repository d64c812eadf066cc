"""Pairs and neighbours of vectors within a repository, found exactly in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.session import broadcast_if_bounded, cut_lineage, ship_package

#: Vectors in a block; a task compares two blocks.
BLOCK = 2000


def usable(vec: Column, length: int = 64) -> Column:
    """Whether a vector has this many finite components that are not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) == length) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def pairs_within(rows: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """``repo, a, b, similarity``: pairs of rows (repo, id, vec) of one repository with a cosine of at least ``least``; a < b.

    Exact: the vectors of a repository are dealt into blocks and every two
    blocks meet in one task as a matrix product.  A repository of up to
    ``block`` vectors is one task; work grows with the square of a repository,
    never with that of the table, and memory with two blocks.

    Defined cases: null repositories are one of their own; vectors must be
    usable and of one length; an id given twice is compared as given.
    """
    ship_package(rows.sparkSession)
    own = rows.select(F.coalesce("repo", F.lit("")).alias("repo"), F.col("id").cast("bigint").alias("id"), "vec").where("id IS NOT NULL")
    sizes = cut_lineage(own.groupBy("repo").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "vector-blocks")
    dealt = own.join(broadcast_if_bounded(sizes), "repo").withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = dealt.select("repo", "id", "vec", "at", other).select(
        "repo", "id", "vec", "at", F.least("at", "other").alias("p"), F.greatest("at", "other").alias("q")
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        p, q = group["p"].iloc[0], group["q"].iloc[0]
        sides = [group[group["at"] == x] for x in (p, q)]
        found = []
        if len(sides[0]) and len(sides[1]):
            unit = [np.stack(s["vec"].to_numpy()).astype(np.float64) for s in sides]
            unit = [u / np.linalg.norm(u, axis=1, keepdims=True) for u in unit]
            ids = [s["id"].to_numpy() for s in sides]
            close = unit[0] @ unit[1].T
            i, j = np.nonzero(close >= least - 1e-12)
            a, b = ids[0][i], ids[1][j]
            keep = a < b if p == q else a != b
            found = [np.minimum(a, b)[keep], np.maximum(a, b)[keep], close[i, j][keep]]
        empty = np.zeros(0)
        a, b, s = found or (empty, empty, empty)
        return pd.DataFrame({"repo": group["repo"].iloc[0], "a": a.astype(np.int64), "b": b.astype(np.int64), "similarity": s})

    return met.groupBy("repo", "p", "q").applyInPandas(compare, "repo string, a bigint, b bigint, similarity double")


def nearest_within(rows: DataFrame, k: int = 5, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """``repo, a, b, similarity``: pairs of which one is among the other's ``k`` nearest at a cosine of ``least`` or more, each once."""
    pairs = cut_lineage(pairs_within(rows, least, block), "near-pairs")
    both = pairs.select("repo", F.col("a").alias("id"), F.col("b").alias("near"), "similarity").unionByName(
        pairs.select("repo", F.col("b").alias("id"), F.col("a").alias("near"), "similarity")
    )
    order = Window.partitionBy("repo", "id").orderBy(F.desc(F.round("similarity", 9)), "near")
    best = both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return best.select("repo", F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b"), "similarity").dropDuplicates(["repo", "a", "b"])
