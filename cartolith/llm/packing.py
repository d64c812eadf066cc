"""Fill containers of several permitted capacities with items of varying length."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.bpe import VOCABULARIES, encode_documents
from cartolith.session import cut_lineage, ship_package

#: Items that one task packs together; each such lot leaves at most one badly filled container.
LOT = 20_000
#: Costs of a container besides its capacity that are tried for each lot, in units of capacity; the first weighs unused
#: room alone, the last opens the largest container whatever it leaves unused.
OVERHEADS = (0.0, 16.0, 256.0, float("inf"))


class _Room:
    """Open containers by room left; finds the tightest fit with one shift of a bit set."""

    def __init__(self) -> None:
        self.bits, self.by_room = 0, {}

    def put(self, container: int, room: int) -> None:
        self.by_room.setdefault(room, []).append(container)
        self.bits |= 1 << room

    def tightest(self, size: int) -> tuple[int, int] | None:
        rest = self.bits >> size
        if not rest:
            return None
        room = size + (rest & -rest).bit_length() - 1
        stack = self.by_room[room]
        container = stack.pop()
        if not stack:
            self.bits ^= 1 << room
        return container, room


class _Waiting:
    """Sizes of the items not yet placed, with their numbers."""

    def __init__(self, sizes: list[int]) -> None:
        self.number = Counter(s for s in sizes if s > 0)
        self.bits = sum(1 << s for s in self.number)

    def take(self, size: int) -> None:
        if size > 0:
            self.number[size] -= 1
            if not self.number[size]:
                del self.number[size]
                self.bits ^= 1 << size

    def leftover(self, room: int) -> int:
        """What of ``room`` stays unused if the largest waiting items that fit are put in, one size after the other."""
        bits = self.bits
        while room and (fit := bits & ((2 << room) - 1)):
            size = fit.bit_length() - 1
            room -= size * min(self.number[size], room // size)
            bits ^= 1 << size
        return room


def opening_size(size: int, waiting: _Waiting, permitted: list[int], overhead: float) -> int:
    """The permitted capacity of least cost for each unit that it is expected to hold, of equals the smallest.

    ``size`` is the item that needs a container; what else the container can
    be expected to hold follows from the sizes that are still waiting.
    """
    fitting = [c for c in permitted if c >= size]
    if overhead == float("inf"):
        return fitting[-1]

    def cost(capacity: int) -> float:
        return (capacity + overhead) / max(1, capacity - waiting.leftover(capacity - size))

    return min(fitting, key=lambda c: (cost(c), c))


def pack_by(sizes: list[int], permitted: list[int], overhead: float) -> tuple[list[int], list[int]]:
    """Best fit with one overhead: (container of each item, what each container holds)."""
    room, filled, where, waiting = _Room(), [], [0] * len(sizes), _Waiting(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[k]
        waiting.take(size)
        found = room.tightest(size)
        if found is None:
            found = len(filled), opening_size(size, waiting, permitted, overhead)
            filled.append(0)
        container, left = found
        room.put(container, left - size)
        filled[container] += size
        where[k] = container
    return where, filled


def pack(sizes: list[int], permitted: list[int]) -> tuple[list[int], dict[int, int]]:
    """Best fit over several permitted capacities: (container of each item, capacity of each container).

    Items are taken from the longest to the shortest (ties in the given
    order).  Each goes into the open container with the least room that holds
    it; if there is none, the capacity of least cost is opened.  At the end
    each container is made as small as its contents permit.  This is done for
    each of ``OVERHEADS``, and the result with the least room is kept (of
    equals the one with fewer containers), so that it never takes more room
    than opening the largest container always would.  Sizes must not exceed
    the largest capacity.
    """
    permitted = sorted(set(permitted))
    best = None
    for overhead in OVERHEADS if len(permitted) > 1 else OVERHEADS[-1:]:
        where, filled = pack_by(sizes, permitted, overhead)
        capacity = {c: next(p for p in permitted if p >= used) for c, used in enumerate(filled)}
        cost = sum(capacity.values()), len(capacity)
        if best is None or cost < best[0]:
            best = cost, where, capacity
    return best[1], best[2]


def fill_containers(items: DataFrame, packs: DataFrame, item: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Assign every item to a container of every pack, splitting only items above the capacity.

    ``items``: ``item`` and integer ``size``.  ``packs``: ``pack_name,
    capacity`` (a small table of parameters, read by the driver).  A pack may
    use its own capacity and each smaller one in ``packs``.

    Result: ``pack_name, container_id, container_capacity, <item>, piece,
    start, length``.  ``container_capacity`` is the least permitted capacity
    that holds the container's contents.  An item above the capacity of the
    pack gives pieces of full capacity, each a container of its own, and a
    rest that is packed like an item; ``start`` says where in the item a piece
    begins.

    Items are dealt into lots of about ``LOT`` by a hash of their id, and each
    lot is packed by one task: memory is bounded whatever the total, and the
    loss is at most one badly filled container in a lot.

    Defined cases: a null or negative size is 0; items of size 0 go into a
    container like any other and take no room; an empty table gives no rows;
    items without id are left out, as they can't be assigned; an item given
    twice is placed twice; null capacities or such below 1 are ignored.
    """
    ship_package(items.sparkSession)
    kinds = {
        r["pack_name"]: int(r["capacity"]) for r in packs.where(F.col("capacity") >= 1).orderBy("capacity").collect()
    }
    spark = items.sparkSession
    kind = dict(items.dtypes)[item]
    schema = (
        f"pack_name string, container_id string, container_capacity bigint, {item} {kind},"
        " piece bigint, start bigint, length bigint"
    )
    if not kinds:
        return spark.createDataFrame([], schema)
    rows = items.select(
        F.col(item).alias("item"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size")
    ).where(F.col("item").isNotNull())
    lots = max(1, -(-rows.count() // LOT))
    choice = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("bigint").alias("capacity")) for n, c in kinds.items()])
    rows = rows.select("item", "size", F.inline(choice)).withColumn("full", F.expr("size div capacity"))
    rows = rows.withColumn(  # what is left over; an item of exactly the capacity has full pieces only
        "rest", F.expr("CASE WHEN size > 0 AND size % capacity = 0 THEN NULL ELSE size % capacity END")
    )
    whole = rows.where("full > 0").select(
        "pack_name", "item", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece")
    )
    whole = whole.select(
        "pack_name",
        F.concat(F.lit("w"), F.col("item").cast("string"), F.lit("."), F.col("piece").cast("string")).alias("container_id"),
        F.col("capacity").alias("container_capacity"),
        F.col("item").alias(item),
        "piece",
        (F.col("piece") * F.col("capacity")).alias("start"),
        F.col("capacity").alias("length"),
    )

    def pack_lot(key: tuple, lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values("item", kind="stable", ignore_index=True)
        pack_name, number = key
        permitted = [c for c in kinds.values() if c <= kinds[pack_name]]
        where, capacity = pack(lot["rest"].tolist(), permitted)
        return pd.DataFrame(
            {
                "pack_name": pack_name,
                "container_id": [f"m{number}.{c}" for c in where],
                "container_capacity": [capacity[c] for c in where],
                item: lot["item"],
                "piece": lot["full"],
                "start": lot["full"] * kinds[pack_name],
                "length": lot["rest"],
            }
        )

    mixed = (
        rows.where("rest IS NOT NULL")
        .select("pack_name", F.pmod(F.xxhash64("item"), F.lit(lots)).alias("lot"), "item", "full", "rest")
        .groupBy("pack_name", "lot")
        .applyInPandas(pack_lot, schema)
    )
    return whole.unionByName(mixed)


def container_report(containers: DataFrame, items: DataFrame, packs: DataFrame, item: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """What must hold of the containers of every pack, one row each.

    ``pack_name, items`` (with an id), ``missing`` (not placed, or not in
    full), ``repeated`` (more than their size placed), ``split`` (in pieces
    though no larger than the capacity), ``overfull`` (containers that hold
    more than their capacity), ``room`` and ``used``.
    """
    sized = items.where(F.col(item).isNotNull()).groupBy(item).agg(
        F.sum(F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))).alias("size"), F.count("*").alias("times")
    )
    kinds = packs.where(F.col("capacity") >= 1).groupBy("pack_name").agg(F.max("capacity")).collect()  # a table of parameters
    own = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("bigint").alias("capacity")) for n, c in kinds])
    placed = containers.groupBy("pack_name", item).agg(F.sum("length").alias("placed"), F.count("*").alias("pieces"))
    wanted = sized.select("*", F.inline(own)).join(placed, ["pack_name", item], "left")
    by_item = wanted.groupBy("pack_name").agg(
        F.count("*").alias("items"),
        F.count_if(F.col("placed").isNull() | (F.col("placed") < F.col("size"))).alias("missing"),
        F.count_if(F.col("placed") > F.col("size")).alias("repeated"),
        F.count_if((F.col("size") <= F.col("capacity")) & (F.col("pieces") > F.col("times"))).alias("split"),
    )
    held = containers.groupBy("pack_name", "container_id", "container_capacity").agg(F.sum("length").alias("held"))
    by_container = held.groupBy("pack_name").agg(
        F.count_if(F.col("held") > F.col("container_capacity")).alias("overfull"),
        F.sum("container_capacity").alias("room"),
        F.sum("held").alias("used"),
    )
    return by_item.join(by_container, "pack_name", "left")


def pack_documents(
    documents: DataFrame, packs: DataFrame, text: str = "text", folder: str = VOCABULARIES
) -> DataFrame:
    """Containers of every pack in ``pack_name, tokenizer, capacity`` for documents sized in tokens.

    Each tokenizer counts the documents once, whatever the number of its packs.
    """
    results: Iterator[DataFrame] = (
        fill_containers(
            cut_lineage(
                encode_documents(documents, text=text, tokenizer=r["tokenizer"], folder=folder, counts_only=True),
                "token-counts",
            ),
            packs.where(F.col("tokenizer") == r["tokenizer"]),
        )
        for r in packs.select("tokenizer").where("tokenizer IS NOT NULL").distinct().orderBy("tokenizer").collect()
    )
    result = None
    for part in results:
        result = part if result is None else result.unionByName(part)
    if result is None:
        raise ValueError("packs names no tokenizer")
    return result
