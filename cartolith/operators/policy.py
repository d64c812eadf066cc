"""Rules over source files and graphs: forbidden imports, numeric statuses, required companions, review flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.operators.retrieval import overlapping_spans
from cartolith.session import broadcast_if_bounded


def forbidden_imports(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """``rule, repo, file, target``: imports (repo, file, target) that a rule (rule, path_pattern, import_pattern) forbids.

    Rules are a small table of parameters, so that every import is tried against each of them.
    """
    return imports.join(broadcast_if_bounded(rules), F.expr("file rlike path_pattern AND target rlike import_pattern")).select(
        "rule", "repo", "file", "target"
    )


def magic_statuses(lines: DataFrame) -> DataFrame:
    """Lines (repo, file, line, text) that use a bare HTTP status instead of a name."""
    return lines.where(
        F.col("text").rlike(r"(?i)\b(?:status|statuscode|code|writeheader)\W{1,3}[1-5]\d\d\b") & ~F.col("text").rlike(r"^\s*(?://|#|\*)")
    )


def missing_companions(changed: DataFrame, rules: DataFrame) -> DataFrame:
    """``rule, repo``: rules (rule, when_pattern, then_pattern) for which a changed file (repo, file) calls for another that did not change."""
    hit = changed.join(broadcast_if_bounded(rules), F.expr("file rlike when_pattern")).select("rule", "repo").distinct()
    met = changed.join(broadcast_if_bounded(rules), F.expr("file rlike then_pattern")).select("rule", "repo").distinct()
    return hit.join(met, ["rule", "repo"], "left_anti")


def changed_symbols(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """``repo, file, name``: symbols (repo, file, name, start_line, end_line) that a hunk (repo, file, start_line, end_line) touches."""
    a = symbols.select("repo", "file", F.col("name").alias("a_id"), F.col("start_line").alias("a_start"), F.col("end_line").alias("a_end"))
    b = hunks.select("repo", "file", F.lit(1).alias("b_id"), F.col("start_line").alias("b_start"), F.col("end_line").alias("b_end"))
    return overlapping_spans(a, b).select("repo", "file", F.col("a_id").alias("name")).distinct()


def review_risk(changed: DataFrame, impact: DataFrame, tested: DataFrame) -> DataFrame:
    """Flags and level of each changed symbol (repo, file, name).

    ``impact``: repo, file, name, callers, band; ``tested``: repo, file, name.
    Flags are untested, exported callers in number and a high band; three
    flags or 20 callers are high, one or 5 callers medium.
    """
    keys = ["repo", "file", "name"]
    joined = changed.join(impact, keys, "left").join(tested.select(*keys).distinct().withColumn("has_test", F.lit(True)), keys, "left")
    callers = F.coalesce("callers", F.lit(0))
    flags = F.filter(
        F.array(
            F.when(F.col("has_test").isNull(), "untested"), F.when(callers > 10, "many_callers"), F.when(F.col("band") == "high", "high_impact")
        ),
        lambda f: f.isNotNull(),
    )
    level = F.when((F.size("flags") >= 3) | (callers >= 20), "high").when((F.size("flags") >= 1) | (callers >= 5), "medium").otherwise("low")
    return joined.withColumn("flags", flags).select(*keys, callers.alias("callers"), F.array_join("flags", ",").alias("flags"), level.alias("level"))


def without_comments(code: Column, indented: bool = False) -> Column:
    """Code without comments; strings that hold comment marks are left alone."""
    strings = r"(\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|`[^`]*+`)"
    marks = r"#[^\n]*" if indented else r"//[^\n]*|(?s:/\*.*?\*/)"
    return F.regexp_replace(code, f"{strings}|{marks}", "$1")
