"""Writing graphs and results: partitioned tables, partial updates, and texts for other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severity of a finding in the words of a static-analysis report.
LEVELS = {"high": "error", "medium": "warning", "low": "note"}


def write_graph(symbols: DataFrame, edges: DataFrame, path: str) -> None:
    """Write a graph's tables below ``path``: symbols once by key, edges by label, so that a label is read alone."""
    symbols.dropDuplicates(["graph", "name", "file"]).write.mode("overwrite").parquet(f"{path}/symbols")
    edges.distinct().write.mode("overwrite").partitionBy("label").parquet(f"{path}/edges")


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replace the partitions of a table that ``rows`` have rows of; the others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def updated(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows with the values that a batch gives for their keys; null gives nothing, and other keys add no rows."""
    values = [c for c in batch.columns if c not in keys]
    new = batch.groupBy(*keys).agg(*[F.max(F.col(c)).alias(f"_{c}") for c in values])
    kept = [F.coalesce(f"_{c}", c).alias(c) if c in values else F.col(c) for c in stored.columns]
    return stored.join(new, keys, "left").select(*kept)


def without_orphans(rows: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the owners have."""
    return rows.join(owners.select(*keys).distinct(), keys, "left_semi")


def table_counts(rows: DataFrame, owners: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """``<group>, rows, orphans``: rows of each group, and those whose key the owners do not have."""
    marked = rows.join(owners.select(*keys).distinct().withColumn("_owned", F.lit(1)), keys, "left")
    return marked.groupBy(group).agg(F.count("*").alias("rows"), F.count_if(F.col("_owned").isNull()).alias("orphans"))


def findings_report(findings: DataFrame, tool: str) -> DataFrame:
    """One row of JSON a rule: the results of findings (rule, level, message, file, line) in the form static-analysis viewers read."""
    level = F.lit("none")
    for ours, theirs in LEVELS.items():
        level = F.when(F.col("level") == ours, theirs).otherwise(level)
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    rolled = findings.groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("file", "line", "message", result.alias("r")))).alias("all"))
    driver = F.struct(F.lit(tool).alias("name"), F.array(F.struct(F.col("rule").alias("id"))).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("all", lambda x: x["r"]).alias("results"))
    return rolled.select("rule", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("json"))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(value, r'["\\]', "_"), F.lit('"'))


def dot_text(edges: DataFrame) -> DataFrame:
    """``graph, text``: the edges (graph, src, dst) of each graph as a digraph."""
    lines = F.array_sort(F.collect_set(F.concat(F.lit("  "), _quoted(F.col("src")), F.lit(" -> "), _quoted(F.col("dst")), F.lit(";"))))
    return edges.groupBy("graph").agg(lines.alias("l")).select("graph", F.concat(F.lit("digraph {\n"), F.array_join("l", "\n"), F.lit("\n}")).alias("text"))


def mermaid_text(edges: DataFrame) -> DataFrame:
    """``graph, text``: the same as a flow chart; names become numbers in sorted order with the name as label."""
    ends = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("src", "dst")))))
    rolled = edges.groupBy("graph").agg(ends.alias("n"), F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("e"))

    def at(x: Column) -> Column:
        return F.concat(F.lit("n"), F.array_position("n", x).cast("string"))

    nodes = F.transform("n", lambda x: F.concat(F.lit("  "), at(x), F.lit("["), _quoted(x), F.lit("]")))
    links = F.transform("e", lambda x: F.concat(F.lit("  "), at(x["src"]), F.lit(" --> "), at(x["dst"])))
    return rolled.select("graph", F.concat(F.lit("graph LR\n"), F.array_join(F.concat(nodes, links), "\n")).alias("text"))


def tree_text(files: DataFrame, most: int = 200) -> DataFrame:
    """``repo, text``: the paths (repo, path) of each repository as an indented tree of at most ``most`` lines."""
    words = F.split("path", "/")
    lines = files.select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.slice(words, 1, n))).alias("p")).distinct()
    shown = F.concat(F.repeat(F.lit("  "), F.size("p") - 1), F.element_at("p", -1))
    rolled = lines.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("p", shown.alias("line")))).alias("all"))
    return rolled.select("repo", F.array_join(F.transform(F.slice("all", 1, most), lambda x: x["line"]), "\n").alias("text"))


def skeletons(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``repo, file, text``: files (repo, path, content) with the bodies of outermost symbols (repo, file, start_line, end_line, signature) left out.

    A symbol inside another is part of its body; its signature and three dots
    stand for the lines of a symbol.
    """
    spans = symbols.where("start_line >= 1 AND end_line >= start_line").groupBy("repo", "file").agg(
        F.array_sort(F.collect_set(F.struct("start_line", (-F.col("end_line")).alias("e"), F.coalesce("signature", F.lit("")).alias("s")))).alias("spans")
    )
    outer = F.aggregate(
        "spans", F.array().cast("array<struct<start_line: int, e: int, s: string>>"),
        lambda a, x: F.when((F.size(a) > 0) & (x["start_line"] <= -F.element_at(a, -1)["e"]), a).otherwise(F.array_append(a, x)),
    )
    lines = F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n")
    joined = files.where("content IS NOT NULL").select("repo", F.col("path").alias("file"), lines.alias("lines")).join(spans.select("repo", "file", outer.alias("outer")), ["repo", "file"])
    shown = F.transform(
        "lines",
        lambda text, i: F.coalesce(
            F.get(F.filter(F.transform(F.filter("outer", lambda o: (i + 1 >= o["start_line"]) & (i + 1 <= -o["e"])), lambda o: F.when(i + 1 == o["start_line"], F.concat(o["s"], F.lit(" ...")))), lambda x: x.isNotNull()), F.lit(0)),
            F.when(~F.exists("outer", lambda o: (i + 1 >= o["start_line"]) & (i + 1 <= -o["e"])), text),
        ),
    )
    return joined.select("repo", "file", F.array_join(F.filter(shown, lambda x: x.isNotNull()), "\n").alias("text"))
