"""The most similar vectors of every vector: a forest of random-projection trees, then exact reranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.session import broadcast_if_bounded, cut_lineage, ship_package

#: Vectors per leaf aimed at, and leaves per tree at most (bounds the broadcast forest to TREES * MAX_LEAVES vectors).
LEAF, MAX_LEAVES, TREES = 1200, 16_384, 3
#: Vectors on which the forest is fitted, at most; every vector is indexed.
FIT_SAMPLE = 65_536
#: Leaves that the shared queue yields for each query.
PROBES = 12
#: The same where only some rows are queries and neighbours of any similarity are wanted.
DEEP_PROBES = 96
#: Rows of a leaf that are compared at once; larger leaves are cut into blocks of about this size.
BLOCK = 8_192
#: How far a cosine of quantised vectors may lie below the exact one.
SLACK = 0.01


@dataclass(frozen=True)
class Forest:
    """Hyperplanes of all trees in heap order: node 0 is a root, 2i+1 lies below its plane, 2i+2 above."""

    planes: np.ndarray  # trees x nodes x dimensions
    offsets: np.ndarray  # trees x nodes
    depth: int

    @property
    def trees(self) -> int:
        return len(self.planes)


def fit_forest(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 1) -> Forest:
    """Split unit vectors by planes between two random, mutually improved centres, at the median.

    A node with fewer than two sample vectors keeps a zero plane, below which
    everything lies.
    """
    nodes, dimensions = 2**depth - 1, sample.shape[1]
    planes = np.zeros((trees, nodes, dimensions), np.float32)
    offsets = np.zeros((trees, nodes), np.float32)
    for tree in range(trees):
        random = np.random.default_rng(seed + tree)
        inside = {0: np.arange(len(sample))}
        for node in range(nodes):
            own = inside.pop(node, np.zeros(0, np.int64))
            above = np.zeros(len(own), bool)
            if len(own) >= 2:
                some = sample[own if len(own) <= 256 else random.choice(own, 256, replace=False)]
                left, right = some[random.choice(len(some), 2, replace=False)].copy()
                for _ in range(6):
                    nearer_right = some @ (right - left) > 0
                    for centre, side in ((right, nearer_right), (left, ~nearer_right)):
                        if side.any():
                            centre[:] = some[side].mean(0)
                            centre /= max(np.linalg.norm(centre), 1e-9)
                plane = right - left
                plane /= max(np.linalg.norm(plane), 1e-9)
                at = sample[own] @ plane
                planes[tree, node], offsets[tree, node] = plane, np.median(at)
                above = at > offsets[tree, node]
            inside[2 * node + 1], inside[2 * node + 2] = own[~above], own[above]
    return Forest(planes, offsets, depth)


def probe(vectors: np.ndarray, forest: Forest, probes: int) -> np.ndarray:
    """The first ``probes`` leaves that one priority queue over all trees yields, for all vectors at once.

    A node's priority is the largest margin by which its path lies on the wrong
    side of a plane.  As a child of each node has the priority of the node
    itself, keeping the best ``probes`` nodes of every level gives exactly the
    leaves that popping the queue node by node would.  Column t holds the
    vector's own leaf in tree t; further columns hold other leaves, -1 if
    there are no more.  Leaves are numbered tree * 2**depth + place.
    """
    n, trees, nodes = len(vectors), forest.trees, 2**forest.depth - 1
    probes = max(probes, trees)
    planes = forest.planes.reshape(trees * nodes, vectors.shape[1])
    offsets = forest.offsets.reshape(-1)
    dense = vectors @ planes.T - offsets if len(planes) <= 4096 else None
    tree = np.tile(np.arange(trees, dtype=np.int32), (n, 1))
    node = np.zeros((n, trees), np.int32)
    wrong = np.zeros((n, trees), np.float32)
    for _ in range(forest.depth):
        at = tree * nodes + node
        if dense is not None:
            margin = np.take_along_axis(dense, at, 1)
        else:
            margin = np.einsum("nd,nbd->nb", vectors, planes[at]) - offsets[at]
        tree = np.concatenate([tree, tree], 1)
        node = np.concatenate([2 * node + 1, 2 * node + 2], 1)
        wrong = np.concatenate(  # exactly one child of a node keeps its priority
            [np.where(margin > 0, np.maximum(wrong, margin), wrong), np.where(margin > 0, wrong, np.maximum(wrong, np.maximum(-margin, 1e-7)))],
            1,
        )
        if wrong.shape[1] > probes:
            best = np.argpartition(wrong, probes - 1, 1)[:, :probes]
            tree, node, wrong = (np.take_along_axis(x, best, 1) for x in (tree, node, wrong))
    leaf = tree * (nodes + 1) + node - nodes
    own = wrong == 0
    order = np.argsort(np.where(own, tree - trees, 0), axis=1, kind="stable")
    leaf = np.take_along_axis(leaf, order, 1)
    if leaf.shape[1] < probes:
        leaf = np.concatenate([leaf, np.full((n, probes - leaf.shape[1]), -1, leaf.dtype)], 1)
    return leaf.astype(np.int32)


def quantise(unit: np.ndarray) -> list[bytes]:
    """A unit vector in one byte a component and its scale in four."""
    scale = np.maximum(np.abs(unit).max(1), 1e-9).astype(np.float32) / 127
    rows = np.concatenate([scale[:, None].view(np.int8), np.rint(unit / scale[:, None]).astype(np.int8)], 1)
    return [row.tobytes() for row in np.ascontiguousarray(rows)]


def dequantise(codes: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(len(codes), -1)
    return rows[:, 4:].astype(np.float32) * np.ascontiguousarray(rows[:, :4]).view(np.float32)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def usable(vector: Column, dimensions: int) -> Column:
    """Whether a vector has ``dimensions`` finite components that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dimensions) & finite & F.exists(vector, lambda x: x != 0)


def current_vectors(
    rows: DataFrame, row_id: str, vector: str, key: list[str], newest: str, dimensions: int
) -> DataFrame:
    """``id, vec``: the newest row of each key, if its vector is usable.  One exchange, on 128 bits of the key."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in key]
    latest = rows.select(
        F.xxhash64(*parts).alias("k1"),
        F.xxhash64(F.lit("second"), *parts).alias("k2"),
        F.struct(F.col(newest).alias("at"), F.col(row_id).alias("id")).alias("version"),
        F.col(vector).alias("vec"),
    ).where(F.col("version.id").isNotNull())
    return (
        latest.groupBy("k1", "k2")
        .agg(F.max_by(F.struct("version.id", "vec"), "version").alias("h"))
        .select("h.*")
        .where(usable(F.col("vec"), dimensions))
    )


def fit_on(rows: DataFrame, vector: str, dimensions: int, total: int) -> Forest:
    """Fit a forest on at most ``FIT_SAMPLE`` vectors; it is as deep as ``total`` vectors need."""
    depth = min(max(0, math.ceil(math.log2(max(1, total / LEAF)))), int(math.log2(MAX_LEAVES)))
    wanted = min(FIT_SAMPLE, 128 * 2**depth)
    good = rows.select(F.col(vector).alias("vec")).where(usable(F.col("vec"), dimensions))
    fraction = min(1.0, 1.5 * wanted / max(1, total))
    table = (good.sample(fraction=fraction, seed=11) if fraction < 1 else good).limit(wanted).toArrow()
    sample = np.zeros((0, dimensions), np.float32)
    if table.num_rows:
        sample = _matrix(table.column(0).combine_chunks(), dimensions).astype(np.float32)
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    return fit_forest(sample, depth)


def index_vectors(vectors: DataFrame, forest: Forest, dimensions: int, probes: int) -> DataFrame:
    """``id, code, leaves, h1, h2``: each vector in one byte a component, its leaves and 128 bits of it."""
    handle = vectors.sparkSession.sparkContext.broadcast(forest)
    kind = dict(vectors.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = handle.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column(1), dimensions).astype(np.float64)
            unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
            leaves = probe(unit, own, probes)
            offsets = pa.array(np.arange(0, leaves.size + 1, leaves.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(quantise(unit), pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(leaves.ravel(), pa.int32())),
                    batch.column(2),
                    batch.column(3),
                ],
                ["id", "code", "leaves", "h1", "h2"],
            )

    hashed = vectors.select(
        "id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("second"), F.reverse("vec")).alias("h2")
    )
    return hashed.mapInArrow(run, f"id {kind}, code binary, leaves array<int>, h1 bigint, h2 bigint")


def _search(listed: int, least: float | None):
    """Compare the queries of one leaf with its vectors; keep the ``listed`` best of each query."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        vectors = dequantise(table.column("code").combine_chunks())
        data = np.flatnonzero(table.column("is_data").to_numpy(zero_copy_only=False))
        queries = np.flatnonzero(table.column("is_query").to_numpy(zero_copy_only=False))
        found = [(np.zeros(0, ids.dtype), np.zeros(0, ids.dtype), np.zeros(0, np.float32))]
        for start in range(0, len(queries) if len(data) else 0, 1024):
            some = queries[start : start + 1024]
            near = vectors[some] @ vectors[data].T
            near[ids[some][:, None] == ids[data]] = -2
            if least is not None:
                line, column = np.nonzero(near >= least - SLACK)
                if len(line) and np.bincount(line).max() <= listed:
                    found.append((ids[some[line]], ids[data[column]], near[line, column]))
                    continue
            n = min(listed, len(data))
            best = np.argpartition(-near, n - 1, 1)[:, :n]
            value = np.take_along_axis(near, best, 1)
            line, column = np.nonzero(value >= (-1.5 if least is None else least - SLACK))
            found.append((ids[some[line]], ids[data[best[line, column]]], value[line, column]))
        q, d, c = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"q": q, "d": d, "approx": c})

    return run


def _blocks(routed: DataFrame) -> DataFrame:
    """Cut leaves of more than ``BLOCK`` rows: each block of vectors meets each block of queries, in tasks of their own."""
    sizes = routed.groupBy("leaf").agg(
        F.ceil(F.count_if("is_data") / BLOCK).cast("int").alias("data_blocks"),
        F.ceil(F.count_if("is_query") / BLOCK).cast("int").alias("query_blocks"),
    )
    large = sizes.where("data_blocks > 1 OR query_blocks > 1")  # at most TREES * MAX_LEAVES rows
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    rows = routed.join(F.broadcast(large), "leaf", "left").withColumns(
        {"db": F.coalesce("data_blocks", F.lit(1)), "qb": F.coalesce(F.greatest("query_blocks", F.lit(1)), F.lit(1))}
    )

    def every(n: str) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)

    one = rows.where("db <= 1 AND qb <= 1").select(
        "leaf", F.lit(0).alias("d_at"), F.lit(0).alias("q_at"), "id", "code", "is_data", "is_query"
    )
    many = rows.where("db > 1 OR qb > 1")
    as_data = many.where("is_data").select(
        "leaf", F.pmod(spread, F.col("db")).cast("int").alias("d_at"), F.explode(every("qb")).alias("q_at"),
        "id", "code", F.lit(True).alias("is_data"), F.lit(False).alias("is_query"),
    )
    as_query = many.where("is_query").select(
        "leaf", F.explode(every("db")).alias("d_at"), F.pmod(spread, F.col("qb")).cast("int").alias("q_at"),
        "id", "code", F.lit(False).alias("is_data"), F.lit(True).alias("is_query"),
    )
    return one.unionByName(as_data).unionByName(as_query)


def leaf_candidates(
    index: DataFrame, trees: int, listed: int, least: float | None, queries: Column | None = None
) -> DataFrame:
    """``q, d, approx``: for each query the best vectors of the leaves it probes, by quantised cosine."""
    asked = F.lit(True) if queries is None else queries
    routed = (
        index.select("id", "code", asked.alias("asked"), F.posexplode("leaves").alias("at", "leaf"))
        .where("leaf >= 0")
        .select(
            "leaf", "id", "code", (F.col("at") < trees).alias("is_data"), F.coalesce("asked", F.lit(False)).alias("is_query")
        )
        .where("is_data OR is_query")
    )
    kind = dict(index.dtypes)["id"]
    return (
        _blocks(routed)
        .groupBy("leaf", "d_at", "q_at")
        .applyInArrow(_search(listed, least), f"q {kind}, d {kind}, approx float")
        .groupBy("q", "d")
        .agg(F.max("approx").alias("approx"))
    )


def exact_cosines(pairs: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """``q, d, cosine`` in double precision; ``pairs`` and ``vectors`` (``id, vec``) must be cheap to read."""
    needed = cut_lineage(
        pairs.select(F.explode(F.array("q", "d")).alias("id")).distinct(), "needed-ids"
    )
    wanted = vectors.join(broadcast_if_bounded(needed), "id", "left_semi").dropDuplicates(["id"])
    joined = pairs.join(wanted.select(F.col("id").alias("q"), F.col("vec").alias("vq")), "q").join(
        wanted.select(F.col("id").alias("d"), F.col("vec").alias("vd")), "d"
    )
    kind = dict(pairs.dtypes)["q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(k), dimensions).astype(np.float64) for k in (2, 3))
            dot = np.einsum("nd,nd->n", a, b)
            size = np.sqrt(np.einsum("nd,nd->n", a, a) * np.einsum("nd,nd->n", b, b))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dot / size)], ["q", "d", "cosine"]
            )

    return joined.select("q", "d", "vq", "vd").mapInArrow(run, f"q {kind}, d {kind}, cosine double")


def _best(pairs: DataFrame, k: int, by: str = "cosine") -> DataFrame:
    """The k best of each q; the limit is applied before the shuffle too, so that a hub does no harm."""
    order = Window.partitionBy("q").orderBy(F.col(by).desc(), "d")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest_neighbors(
    rows: DataFrame,
    k: int = 5,
    least: float | None = None,
    queries: Callable[[Column], Column] | None = None,
    probes: int = PROBES,
    row_id: str = "vec_id",
    vector: str = "embedding",
    key: tuple[str, ...] = ("repo_key", "file_path", "symbol_name"),
    newest: str = "updated_at",
    dimensions: int = 64,
) -> DataFrame:
    """``q, d, cosine, place``: the k most similar vectors of every query, the row itself excluded.

    Only the newest row of each key counts, and only if its vector has
    ``dimensions`` finite components that are not all zero.  ``queries`` gives a
    condition on the id (default: all are queries), ``least`` the cosine below
    which a neighbour is of no interest; it lets leaves drop most comparisons.

    A forest fitted on a bounded sample is broadcast (at most TREES *
    MAX_LEAVES planes); every vector is indexed in one leaf of each tree, each
    query probes the leaves that a queue shared by all trees yields first, and
    the candidates found there are ranked again by exact cosines.  When all
    are queries a pair found from one side counts for both.  Vectors travel in
    one byte a component; exact ones are joined to the candidates only.

    Identical vectors are collapsed to the one with the smallest id before the
    search and expanded after it: a member's neighbours are first its other
    copies by id, then the members of near groups by id, cut to k.

    Defined cases: null, short, long, all-zero and NaN vectors are neither
    query nor result; null ids are ignored, null parts of a key are a value of
    their own; equal cosines are ranked by id; an empty table gives no rows;
    columns beyond the named ones are not read.
    """
    ship_package(rows.sparkSession)
    source = rows.select(*dict.fromkeys([row_id, vector, newest, *key]))
    total = source.count()
    forest = fit_on(source, vector, dimensions, total)
    index = cut_lineage(
        index_vectors(
            current_vectors(source, row_id, vector, list(key), newest, dimensions), forest, dimensions, probes
        ),
        "vector-index",
    )
    exact = source.select(F.col(row_id).alias("id"), F.col(vector).alias("vec"))

    # Copies: k + 1 smallest ids of each group of identical vectors, limited before the shuffle.
    same = Window.partitionBy("h1", "h2").orderBy("id")
    firsts = (
        index.select("id", "h1", "h2")
        .withColumn("n", F.row_number().over(same))
        .where(F.col("n") <= k + 1)
        .groupBy("h1", "h2")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .where(F.size("ids") > 1)
    )
    firsts = cut_lineage(firsts, "copies")
    members = index.select("id", "h1", "h2").join(broadcast_if_bounded(firsts), ["h1", "h2"])
    members = cut_lineage(members.select("id", F.col("ids")[0].alias("rep"), "ids"), "copy-members")
    extra = members.where("id <> rep").select("id")
    distinct = index.join(broadcast_if_bounded(extra), "id", "left_anti")
    asked = None
    if queries is not None:  # a representative must be searched if any member is a query
        asking = members.where(queries(F.col("id"))).select(F.col("rep").alias("id"), F.lit(True).alias("by_copy")).distinct()
        distinct = distinct.join(broadcast_if_bounded(asking), "id", "left")
        asked = queries(F.col("id")) | F.col("by_copy").isNotNull()

    found = leaf_candidates(distinct, forest.trees, 2 * k + 5, least, asked)
    if queries is None:
        both = found.select(F.least("q", "d").alias("q"), F.greatest("q", "d").alias("d"), "approx")
        found = both.groupBy("q", "d").agg(F.max("approx").alias("approx"))
    elif least is None:
        found = _best(found, 3 * k, "approx")
    found = cut_lineage(found.select("q", "d"), "candidates")
    ranked = exact_cosines(found, exact, dimensions)
    if queries is None:
        ranked = ranked.select(
            F.explode(F.array(F.struct("q", "d", "cosine"), F.struct(F.col("d").alias("q"), F.col("q").alias("d"), "cosine")))
        ).select("col.*")
    if least is not None:
        ranked = ranked.where(F.col("cosine") >= least)
    ranked = _best(ranked, k)

    # Expand near groups to their members, then give every copy its own list.
    reps = cut_lineage(firsts.select(F.col("ids")[0].alias("d"), "ids"), "copy-reps")
    lists = ranked.join(broadcast_if_bounded(reps), "d", "left").select(
        "q", F.explode(F.coalesce(F.slice("ids", 1, k), F.array("d"))).alias("d"), "cosine"
    )
    lists = cut_lineage(_best(lists, k), "lists")
    few = broadcast_if_bounded(members.select(F.col("id").alias("copy"), F.col("rep").alias("q"), "ids"))
    alone = lists.join(broadcast_if_bounded(reps.select(F.col("d").alias("q"))), "q", "left_anti")
    own = few.select(
        F.col("copy").alias("q"),
        F.posexplode(F.slice(F.array_remove("ids", F.col("copy")), 1, k)).alias("at", "d"),
    ).select("q", "d", F.lit(1.0).alias("cosine"), (F.col("at") + 1).alias("place"))
    beside = few.join(lists, "q").withColumn("shift", F.least(F.size("ids") - 1, F.lit(k)))
    beside = beside.where(F.col("place") + F.col("shift") <= k).select(
        F.col("copy").alias("q"), "d", "cosine", (F.col("place") + F.col("shift")).alias("place")
    )
    result = alone.select("q", "d", "cosine", "place").unionByName(own).unionByName(beside)
    return result if queries is None else result.where(queries(F.col("q")))

