"""Duplicates of symbols: equal hashes, near vectors, filters and tiers."""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions.predicates import is_test_file
from cartolith.operators.graph_algorithms import components
from cartolith.operators.vectors import nearest_within
from cartolith.session import cut_lineage, ship_package


def exact_groups(symbols: DataFrame, least: int = 2) -> DataFrame:
    """``body_hash, symbols, repos``: groups of equal body hashes, 0 being no hash.  No pairs are formed."""
    return symbols.where(F.col("body_hash") != 0).groupBy("body_hash").agg(
        F.count("*").alias("symbols"), F.count_distinct("repo_key").alias("repos")
    ).where(F.col("symbols") >= least)


def exact_members(symbols: DataFrame) -> DataFrame:
    """``first_id, entry_id``: members of groups of equal hashes with the smallest id; a link per member, not per pair."""
    own = symbols.where(F.col("body_hash") != 0).select("entry_id", "body_hash")
    groups = own.groupBy("body_hash").agg(F.min("entry_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return own.join(groups, "body_hash").where("entry_id <> first_id").select("first_id", "entry_id")


def duplication_ratio(symbols: DataFrame) -> DataFrame:
    """Per repository the share of functions with a hash that another of its functions has."""
    own = symbols.where((F.col("body_hash") != 0) & F.col("kind").isin("function", "method"))
    groups = own.groupBy("repo_key", "body_hash").agg(F.count("*").alias("n"))
    return groups.groupBy("repo_key").agg(
        F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("ratio"),
        F.sum("n").alias("functions"),
    )


def first_failing_filter(pairs: DataFrame) -> DataFrame:
    """Add ``dropped``: the first filter that a pair fails, or null.

    ``pairs``: symbol_a, file_a, kind_a, symbol_b, file_b, kind_b, calls,
    siblings, tags_disjoint.  In order: tests, same file, kinds, build tags,
    call edge, interface siblings.
    """
    dropped = (
        F.when(is_test_file(F.col("file_a")) | is_test_file(F.col("file_b")), "test")
        .when(F.col("file_a") == F.col("file_b"), "same_file")
        .when(F.col("kind_a") != F.col("kind_b"), "kind")
        .when(F.col("tags_disjoint"), "build_tags")
        .when(F.col("calls"), "calls")
        .when(F.col("siblings"), "siblings")
    )
    return pairs.withColumn("dropped", dropped)


def tier(similarity: Column, exact: Column, close: float = 0.88, related: float = 0.80) -> Column:
    return F.when(exact, "exact").when(similarity >= close, "very_close").when(similarity >= related, "related")


def drop_counts(filtered: DataFrame) -> DataFrame:
    """How many pairs each filter dropped, ``kept`` for the rest."""
    return filtered.groupBy(F.coalesce("dropped", F.lit("kept")).alias("reason")).agg(F.count("*").alias("pairs"))


def sibling_pairs(symbols: DataFrame) -> DataFrame:
    """Groups of methods of one name and parameter list on different receivers: ``repo, name, params, receivers``."""
    params = F.regexp_replace(F.regexp_extract("signature", r"\w+\s*(\([^)]*\))[^(]*$", 1), r"\s+", " ")
    return symbols.where((F.col("kind") == "method") & F.col("receiver").isNotNull()).groupBy(
        "repo_key", "name", params.alias("params")
    ).agg(F.count_distinct("receiver").alias("receivers")).where("receivers > 1")


def common_interface_pairs(implements: DataFrame) -> DataFrame:
    """``graph, a, a_file, b, b_file``: types (src, src_file) that implement an interface (dst, dst_file) in common, each pair once.

    Pairs of one interface grow with the square of its types; exact groups and
    filters are asked for candidate pairs instead (``sharing_interface``).
    """
    own = implements.select("graph", "src", "src_file", "dst", "dst_file").distinct()
    left = own.select("graph", "dst", "dst_file", F.col("src").alias("a"), F.col("src_file").alias("a_file"))
    right = own.select("graph", "dst", "dst_file", F.col("src").alias("b"), F.col("src_file").alias("b_file"))
    met = left.join(right, ["graph", "dst", "dst_file"]).where(F.struct("a", "a_file") < F.struct("b", "b_file"))
    return met.select("graph", "a", "a_file", "b", "b_file").distinct()


def sharing_interface(pairs: DataFrame, implements: DataFrame) -> DataFrame:
    """Of pairs (a, b) of types those that implement an interface (type, interface) in common; joined by pair, never within an interface."""
    own = implements.select("type", "interface").distinct()
    left = pairs.select("a", "b").distinct().join(own.select(F.col("type").alias("a"), "interface"), "a")
    return left.join(own.select(F.col("type").alias("b"), "interface"), ["b", "interface"]).select("a", "b").distinct()


def connected_pairs(pairs: DataFrame, calls: DataFrame) -> DataFrame:
    """Of pairs (a, b) those between which there is a call (src, dst) in either direction."""
    linked = calls.select(F.least("src", "dst").alias("_lo"), F.greatest("src", "dst").alias("_hi")).distinct()
    keyed = pairs.withColumns({"_lo": F.least("a", "b"), "_hi": F.greatest("a", "b")})
    return keyed.join(linked, ["_lo", "_hi"], "left_semi").drop("_lo", "_hi")


# Platforms of which a build has one.
SYSTEMS = "linux darwin windows freebsd netbsd openbsd dragonfly solaris illumos aix plan9 android ios js wasip1".split()
MACHINES = "amd64 386 arm arm64 ppc64 ppc64le mips mipsle mips64 mips64le riscv64 s390x wasm loong64".split()


def build_constraint(path: Column, content: Column) -> Column:
    """The build constraint of a Go file, from its head and its name's endings; null without any."""
    head = F.nullif(F.regexp_extract(F.substring_index(content, "\npackage ", 1), r"(?m)^//go:build (.+)$", 1), F.lit(""))
    system = F.nullif(F.regexp_extract(path, r"_(" + "|".join(SYSTEMS) + r")(?:_[a-z0-9]+)?(?:_test)?\.go$", 1), F.lit(""))
    machine = F.nullif(F.regexp_extract(path, r"_(" + "|".join(MACHINES) + r")(?:_test)?\.go$", 1), F.lit(""))
    parts = F.filter(F.array(F.concat(F.lit("("), head, F.lit(")")), system, machine), lambda x: x.isNotNull())
    return F.nullif(F.array_join(parts, " && "), F.lit(""))


def constraints_disjoint(a: str | None, b: str | None, most: int = 12) -> bool:
    """Whether no build meets both constraints; constraints of more than ``most`` free tags are taken to be compatible."""
    if not a or not b:
        return False
    tags = set(re.findall(r"[A-Za-z_][\w.]*", f"{a} {b}"))
    systems, machines = [t for t in SYSTEMS if t in tags] + [""], [t for t in MACHINES if t in tags] + [""]
    free = sorted(tags - set(SYSTEMS) - set(MACHINES))
    if len(free) > most or re.search(r"[^\w\s.()!&|]", a + b):
        return False
    text = re.sub(r"!", " not ", f"({a}) && ({b})".replace("&&", " and ").replace("||", " or "))
    test = re.sub(r"[A-Za-z_][\w.]*", lambda m: m[0] if m[0] in ("and", "or", "not") else f"({m[0]!r} in on)", text)
    try:
        code = compile(test.strip(), "constraint", "eval")
    except SyntaxError:
        return False
    for system, machine in itertools.product(systems, machines):
        for chosen in itertools.product((False, True), repeat=len(free)):
            if eval(code, {"__builtins__": {}}, {"on": {system, machine, *(t for t, c in zip(free, chosen) if c)}}):  # names are quoted above
                return False
    return True


def with_disjoint_tags(pairs: DataFrame) -> DataFrame:
    """Add ``tags_disjoint`` to pairs with constraints ``tags_a`` and ``tags_b``; each distinct pair of constraints is looked at once."""
    ship_package(pairs.sparkSession)

    @F.pandas_udf("boolean")
    def disjoint(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([constraints_disjoint(x, y) for x, y in zip(a, b, strict=True)])

    kinds = pairs.where("tags_a IS NOT NULL AND tags_b IS NOT NULL").select("tags_a", "tags_b").distinct()
    kinds = kinds.withColumn("_disjoint", disjoint("tags_a", "tags_b"))
    return pairs.join(kinds, ["tags_a", "tags_b"], "left").withColumn("tags_disjoint", F.coalesce("_disjoint", F.lit(False))).drop("_disjoint")


def near_groups(pairs: DataFrame) -> DataFrame:
    """``component, symbols, similarity, tier``: connected groups of pairs (a, b, similarity), their mean and strongest pair's tier."""
    own = cut_lineage(pairs.select("a", "b", "similarity"), "near-pairs")
    label = components(own.select("a", "b"))
    sizes = label.groupBy("component").agg(F.count("*").alias("symbols"))
    strength = own.join(label.select(F.col("id").alias("a"), "component"), "a").groupBy("component").agg(
        F.round(F.avg("similarity"), 6).alias("similarity"), F.max("similarity").alias("_best")
    )
    return sizes.join(strength, "component").select("component", "symbols", "similarity", tier(F.col("_best"), F.lit(False)).alias("tier"))


def duplicate_ratio(pairs: DataFrame, functions: DataFrame) -> DataFrame:
    """``repo, ratio``: functions (repo, id) that have a partner in pairs (repo, a, b), as a share of all."""
    ends = pairs.select("repo", F.col("a").alias("id")).unionByName(pairs.select("repo", F.col("b").alias("id"))).distinct()
    hit = ends.groupBy("repo").agg(F.count("*").alias("hit"))
    total = functions.groupBy("repo").agg(F.count_distinct("id").alias("n"))
    return total.join(hit, "repo", "left").select("repo", F.round(F.coalesce("hit", F.lit(0)) / F.col("n"), 6).alias("ratio"))


#: Functions of a repository above which no near duplicates are looked for.
MOST_FUNCTIONS = 5000


def candidate_pairs(functions: DataFrame, least: float = 0.8, k: int = 5, most: int | None = MOST_FUNCTIONS) -> DataFrame:
    """Near pairs of functions (repo, id, vec) of repositories with at most ``most`` of them: repo, a, b, similarity."""
    if most is not None:
        fitting = functions.groupBy("repo").agg(F.count("*").alias("_n")).where(F.col("_n") <= most).select("repo")
        functions = functions.join(fitting, "repo", "left_semi")
    return nearest_within(functions, k, least)


def judged_pairs(pairs: DataFrame, functions: DataFrame, calls: DataFrame, siblings: DataFrame) -> DataFrame:
    """Pairs with the first filter they fail (``dropped``), in the order of ``first_failing_filter``.

    ``functions``: id, name, file, kind, tags; ``calls``: src, dst by id;
    ``siblings``: a, b by id, methods of types that share an interface.
    """
    for s in "ab":
        about = functions.select(
            F.col("id").alias(s), F.col("name").alias(f"symbol_{s}"), F.col("file").alias(f"file_{s}"), F.col("kind").alias(f"kind_{s}"), F.col("tags").alias(f"tags_{s}")
        )
        pairs = pairs.join(about, s)
    keys = cut_lineage(pairs, "judged-pairs")
    called = connected_pairs(keys.select("a", "b"), calls).distinct().withColumn("calls", F.lit(True))
    kin = siblings.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("siblings", F.lit(True))
    marked = with_disjoint_tags(keys).join(called, ["a", "b"], "left").join(kin, ["a", "b"], "left")
    marked = marked.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("calls", "siblings")})
    return first_failing_filter(marked)


def triage(functions: DataFrame, calls: DataFrame, siblings: DataFrame, least: float = 0.8, k: int = 5, most: int | None = MOST_FUNCTIONS) -> DataFrame:
    """``repo, first_id, symbols, similarity, tier``: groups of duplicate functions, exact ones and those of near vectors.

    ``functions``: repo, id, name, file, kind, tags, body_hash, vec.  Exact:
    equal body hashes (0 is none).  Near: pairs of the k nearest that pass all
    filters, connected; the strongest pair names the tier.
    """
    functions = cut_lineage(functions, "triage-functions")
    exact = functions.where(F.coalesce("body_hash", F.lit(0)) != 0).groupBy("repo", "body_hash").agg(F.min("id").alias("first_id"), F.count("*").alias("symbols"))
    exact = exact.where("symbols > 1").select("repo", "first_id", "symbols", F.lit(1.0).alias("similarity"), F.lit("exact").alias("tier"))
    pairs = candidate_pairs(functions.where("vec IS NOT NULL").select("repo", "id", "vec"), least, k, most)
    kept = cut_lineage(judged_pairs(pairs, functions, calls, siblings).where("dropped IS NULL"), "kept-pairs")
    near = near_groups(kept).join(functions.select(F.col("id").alias("component"), "repo"), "component")
    return exact.unionByName(near.select("repo", F.col("component").alias("first_id"), "symbols", "similarity", "tier"))
