"""Collapse records that differ only in how they are set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.session import cut_lineage

#: Characters that end a member of a record whose members have no order.
MEMBER_ENDS = r"[\n\r,;{}]"


def letters_and_digits(text: Column) -> Column:
    """Letters and digits of ``text`` in order, without regard to case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def canonical_text(text: Column, unordered: Column) -> Column:
    """The text that all copies of a record share.

    Where ``unordered`` is true the members (ended by newline, comma, semicolon
    or brace) are sorted, so that their order does not matter.
    """
    members = F.filter(
        F.transform(F.split(text, MEMBER_ENDS), letters_and_digits), lambda member: member != F.lit("")
    )
    return F.when(unordered, F.array_join(F.array_sort(members), "\n")).otherwise(letters_and_digits(text))


def _digest(text: Column) -> Column:
    """256 bits of a text, to join on; groups are formed on the texts themselves."""
    return F.unhex(F.sha2(text, 256))


def _entries(records: DataFrame, record_id: str, text: str, kind: str, kinds: tuple[str, ...]) -> DataFrame:
    return records.select(
        F.col(record_id).alias("rid"),
        F.col(text).alias("raw"),
        F.coalesce(F.col(kind).isin(*kinds), F.lit(False)).alias("unordered"),
    ).where(F.col("rid").isNotNull() & (F.length("raw") > 0))


def distinct_texts(entries: DataFrame) -> DataFrame:
    """One row per distinct raw text with its smallest id and its number of rows.

    Combined before the exchange, so that each task sends a text once, however
    often it holds it.
    """
    return (
        entries.groupBy("raw", "unordered")
        .agg(F.min("rid").alias("raw_first"), F.count("*").alias("raw_copies"))
        .select(
            _digest(F.col("raw")).alias("raw_key"),
            "unordered",
            canonical_text(F.col("raw"), F.col("unordered")).alias("canon"),
            "raw_first",
            "raw_copies",
        )
        .where(F.col("canon") != "")
    )


def repeated_rows(entries: DataFrame) -> DataFrame:
    """``raw_key, unordered, surplus``: how many rows of a raw text only repeat an id; digests stand for the texts.

    Rows are summed by id before they are summed by text, so that a text of a
    third of all rows is spread over all tasks.
    """
    rows = entries.groupBy(_digest(F.col("raw")).alias("raw_key"), "unordered", "rid").agg(F.count("*").alias("n"))
    return rows.where("n > 1").groupBy("raw_key", "unordered").agg(F.sum(F.col("n") - 1).alias("surplus"))


def copy_groups(distinct: DataFrame) -> DataFrame:
    """Group distinct texts on their canonical text in full, summing the copies."""
    return (
        distinct.groupBy("canon", "unordered")
        .agg(F.min("raw_first").alias("first_id"), F.sum("raw_copies").alias("copies"))
        .select(_digest(F.col("canon")).alias("canon_key"), "unordered", "first_id", "copies")
    )


def collapse_copies(
    records: DataFrame,
    record_id: str = "entry_id",
    text: str = "body",
    kind: str = "kind",
    unordered_kinds: tuple[str, ...] = ("struct",),
) -> DataFrame:
    """One row per record that is left, ``first_id, copies``: the smallest id of each group and its size.

    Byte-identical raw texts are collapsed first, with counts; only distinct
    survivors are made canonical, and these are grouped again on the canonical
    text in full, summing the counts.

    Defined cases: null and empty texts, null ids and texts without any letter
    or digit belong to no group; a null kind is a kind with ordered members;
    rows repeated whole count once; an empty table gives no rows; records of
    kinds with and without ordered members are not compared with each other;
    only the three named columns are read, whatever else the table holds.
    """
    entries = _entries(records, record_id, text, kind, unordered_kinds)
    distinct = distinct_texts(entries).join(repeated_rows(entries), ["raw_key", "unordered"], "left")
    once = distinct.withColumn("raw_copies", F.col("raw_copies") - F.coalesce("surplus", F.lit(0)))
    return copy_groups(once).select("first_id", "copies")


def copy_members(
    records: DataFrame,
    record_id: str = "entry_id",
    text: str = "body",
    kind: str = "kind",
    unordered_kinds: tuple[str, ...] = ("struct",),
) -> DataFrame:
    """The copies in each group of :func:`collapse_copies`: ``first_id, entry_id``, n - 1 rows for a group of n.

    The groups come from the same two-stage collapse; entries are then joined
    to them by digests of 32 bytes, never by their texts.  Rows that only
    repeat an id need not be counted here: a group that holds one id gives no
    row.  A hot text has one row on the side of the groups, so that a skewed
    partition can be split.
    """
    entries = _entries(records, record_id, text, kind, unordered_kinds)
    distinct = cut_lineage(distinct_texts(entries), "distinct-texts")
    groups = copy_groups(distinct).where(F.col("copies") > 1)
    keyed = distinct.select("raw_key", "unordered", _digest(F.col("canon")).alias("canon_key"))
    owners = keyed.join(groups, ["canon_key", "unordered"]).select("raw_key", "unordered", "first_id")
    return (
        entries.select("rid", _digest(F.col("raw")).alias("raw_key"), "unordered")
        .join(owners, ["raw_key", "unordered"])
        .where(F.col("rid") != F.col("first_id"))
        .select("first_id", F.col("rid").alias("entry_id"))
        .distinct()
    )
