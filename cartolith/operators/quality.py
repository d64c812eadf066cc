"""Metrics of functions and repositories, grades, dead code, matches between symbol lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import complexity, stats
from cartolith.functions.predicates import is_entry_point, is_exported, is_test_file
from cartolith.functions.text import name_similarity
from cartolith.session import cut_lineage

CALLABLE = ("function", "method")

#: Sub-scores of a grade: area, measure, value at which it is full, value at which it is nothing, weight.
GRADE = (
    ("cognitive_complexity", "avg_cognitive", 5.0, 25.0, 0.12),
    ("cyclomatic_avg", "avg_complexity", 3.0, 15.0, 0.07),
    ("cyclomatic_max", "max_complexity", 8.0, 25.0, 0.05),
    ("test_coverage", "test_ratio", 0.3, 0.0, 0.12),
    ("doc_coverage", "doc_ratio", 0.6, 0.0, 0.09),
    ("func_size", "avg_lines", 15.0, 60.0, 0.08),
    ("error_handling", "error_ratio", 0.6, 0.0, 0.08),
    ("nesting_depth", "max_nesting", 2.0, 7.0, 0.07),
    ("file_size", "large_ratio", 0.0, 0.5, 0.07),
    ("duplication", "duplication", 0.0, 0.2, 0.05),
    ("magic_numbers", "magic_ratio", 0.0, 1 / 3, 0.06),
    ("semantic_duplication", "semantic_ratio", 0.0, 0.25, 0.02),
    ("dep_freshness", "fresh_ratio", 0.8, 0.0, 0.06),
    ("vuln_security", "secure_ratio", 1.0, 0.0, 0.06),
)
#: Areas that do not apply where dependencies were looked for and there are none.
OF_DEPENDENCIES = ("dep_freshness", "vuln_security")
#: Letters by least score.
LETTERS = ((90, "A+"), (80, "A"), (70, "B"), (60, "C"), (50, "D"))
#: Shortfall of a sub-score below which nothing is recommended.
LEAST_GAP = 0.05


def exported_for_docs(name: Column, language: Column, public: Column) -> Column:
    """Public by declaration, else by a capital first letter where that is the custom, else by no leading underscore."""
    capital = F.lower(F.coalesce(language, F.lit(""))).isin("go", "java", "csharp")
    return F.coalesce(public, F.lit(False)) | F.when(capital, name.rlike("^[A-Z]")).otherwise(~name.rlike("^_") & (name != ""))


def function_measures(entries: DataFrame) -> DataFrame:
    """Functions and methods with lines, cyclomatic and cognitive complexity, nesting, magic numbers, parameters and error handling."""
    language = F.lower(F.coalesce("language", F.lit("")))
    lines = F.when(F.col("end_line") >= F.col("start_line"), F.col("end_line") - F.col("start_line") + 1).otherwise(1)
    body, signature = F.col("body"), F.col("signature")
    test = F.coalesce(is_test_file(F.col("file")), F.lit(False))
    needs = complexity.needs_error_handling(signature, body) & ~test
    return entries.where(F.col("kind").isin(*CALLABLE)).select(
        "repo_key", "file", "name", "start_line", F.coalesce(lines, F.lit(1)).alias("lines"),
        complexity.cyclomatic(body, language).alias("cyclomatic"),
        complexity.cognitive(body, language).alias("cognitive"),
        complexity.nesting(body, language).alias("nesting"),
        F.when(~test, complexity.magic_numbers(body, language)).alias("magic"),
        F.when(F.coalesce(signature, F.lit("")) != "", complexity.parameters(signature)).alias("parameters"),
        F.when(needs, complexity.handles_errors(signature, body, lines).cast("int")).alias("handled"),
    )


def function_metrics(entries: DataFrame) -> DataFrame:
    """Per repository: functions, mean and greatest lines, complexity, cognitive complexity, nesting and parameters, and ratios.

    ``error_ratio``: functions that need error handling and have it; test files
    left out there and in ``magic_ratio``.  ``doc_ratio``: exported symbols of
    any kind with a comment.  ``interfaces``: symbols of that kind.
    """
    measured = function_measures(entries).groupBy("repo_key").agg(
        F.count("*").alias("functions"),
        *[f for c, name in (("lines", "lines"), ("cyclomatic", "complexity"), ("cognitive", "cognitive"), ("nesting", "nesting"), ("parameters", "parameters"))
          for f in (F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"avg_{name}"), F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(f"max_{name}"))],
        F.round(F.coalesce(F.avg("handled"), F.lit(0.0)), 6).alias("error_ratio"),
        F.round(F.coalesce(F.avg((F.col("magic") > 0).cast("int")), F.lit(0.0)), 6).alias("magic_ratio"),
    )
    documented = (F.length("doc_comment") > 0).cast("int")
    public = F.col("is_public") if "is_public" in entries.columns else F.lit(None).cast("boolean")
    whole = entries.groupBy("repo_key").agg(
        F.round(F.coalesce(F.avg(F.when(exported_for_docs(F.col("name"), F.col("language"), public), F.coalesce(documented, F.lit(0)))), F.lit(0.0)), 6).alias("doc_ratio"),
        F.count_if(F.col("kind") == "interface").alias("interfaces"),
    )
    return measured.join(whole, "repo_key")


def magic_numbers(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Functions outside test files that hold magic numbers, most first."""
    found = function_measures(entries).where(F.col("magic") > 0).select("repo_key", "file", "name", "start_line", "magic")
    return found if limit is None else found.orderBy(F.desc("magic"), "repo_key", "file", "name", "start_line").limit(limit)


def repository_ratios(files: DataFrame) -> DataFrame:
    """Per repository the number of files and the shares of test files and of files over 250 lines."""
    return files.groupBy("repo").agg(
        F.count("*").alias("files"),
        F.round(F.avg(is_test_file(F.col("path")).cast("double")), 6).alias("test_ratio"),
        F.round(F.avg((F.coalesce("lines", F.lit(0)) > 250).cast("double")), 6).alias("large_ratio"),
    )


def sub_scores(columns: list[str]) -> list[tuple[str, Column, float]]:
    """Area, score 0..1 and weight of each sub-score; measures that are not among ``columns`` count as 0."""
    found = []
    for area, measure, best, worst, weight in GRADE:
        value = F.coalesce(F.col(measure).cast("double"), F.lit(0.0)) if measure in columns else F.lit(0.0)
        score = stats.clamp((value - worst) / (best - worst))
        if area in OF_DEPENDENCIES and {"deps_scanned", "total_deps"} <= set(columns):
            score = F.when(F.col("deps_scanned") & (F.coalesce("total_deps", F.lit(0)) == 0), 1.0).otherwise(score)
        found.append((area, score, weight))
    return found


def grade(metrics: DataFrame) -> DataFrame:
    """Add ``score`` (0 to 100, whole) and ``grade`` (A+ to F): 14 weighted sub-scores less a penalty for dead code.

    Each likely dead function (``dead_code``, if there is such a column) costs
    0.4 points, 8 at most.  A repository without files has the score 0.
    """
    total = reduce(lambda a, b: a + b, [score * weight for _, score, weight in sub_scores(metrics.columns)])
    dead = F.coalesce(F.col("dead_code").cast("double"), F.lit(0.0)) if "dead_code" in metrics.columns else F.lit(0.0)
    score = F.round(F.greatest(F.lit(0.0), F.round(100 * total, 9) - F.least(F.lit(8.0), 0.4 * dead)))
    if "files" in metrics.columns:
        score = F.when(F.coalesce("files", F.lit(0)) == 0, 0.0).otherwise(score)
    letter = F.lit("F")
    for least, name in reversed(LETTERS):
        letter = F.when(F.col("score") >= least, name).otherwise(letter)
    return metrics.withColumn("score", score).withColumn("grade", letter)


def recommendations(metrics: DataFrame, least: float = LEAST_GAP) -> DataFrame:
    """``repo_key, area, points, potential``: what each area could add to the score, areas short of less than ``least`` left out."""
    parts = [
        F.struct(F.lit(area).alias("area"), (1 - score).alias("gap"), F.round(100 * weight * (1 - score), 4).alias("points"))
        for area, score, weight in sub_scores(metrics.columns)
    ]
    found = metrics.select("repo_key", F.inline(F.array(*parts))).where(F.round("gap", 9) >= least)
    return found.select("repo_key", "area", "points", F.round("points").cast("int").alias("potential"))


def outliers(entries: DataFrame) -> DataFrame:
    """Per repository the most complex and the longest function; ties by file and name."""
    lines = F.col("end_line") - F.col("start_line") + 1
    own = entries.where(F.col("kind").isin(*CALLABLE))

    def most(value: Column, name: str) -> Column:
        return F.min_by("name", F.struct(-F.coalesce(value, F.lit(0)), "file", "name")).alias(name)

    return own.groupBy("repo_key").agg(most(F.col("complexity"), "most_complex"), most(lines, "longest"))


def file_complexity(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("kind").isin(*CALLABLE)).groupBy("repo_key", "file").agg(
        F.round(F.avg("complexity"), 6).alias("complexity")
    )


def language_shares(files: DataFrame) -> DataFrame:
    """Files per language of each repository with their share and whether the language is the dominant one."""
    counts = files.where(F.col("language").isNotNull()).groupBy("repo", "language").agg(F.count("*").alias("files"))
    own = Window.partitionBy("repo")
    first = F.row_number().over(own.orderBy(F.desc("files"), "language")) == 1
    return counts.withColumns(
        {"share": F.round(F.col("files") / F.sum("files").over(own), 6), "dominant": first}
    )


def call_ratios(calls: DataFrame) -> DataFrame:
    """Per graph the shares of calls across files and across packages."""
    from cartolith.sources.tables import package_of

    return calls.groupBy("graph").agg(
        F.count("*").alias("calls"),
        F.round(F.avg((F.col("src_file") != F.col("dst_file")).cast("double")), 6).alias("cross_file"),
        F.round(F.avg((package_of(F.col("src_file")) != package_of(F.col("dst_file"))).cast("double")), 6).alias("cross_package"),
    )


def fans(imports: DataFrame) -> DataFrame:
    """Packages with the number of packages they import and that import them; ``imports``: graph, src, dst."""
    edges = imports.select("graph", "src", "dst").distinct()
    out = edges.groupBy("graph", F.col("src").alias("package")).agg(F.count("*").alias("fan_out"))
    into = edges.groupBy("graph", F.col("dst").alias("package")).agg(F.count("*").alias("fan_in"))
    return out.join(into, ["graph", "package"], "full_outer").select(
        "graph", "package", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out")
    )


def relation_counts(edges: DataFrame) -> DataFrame:
    """Edges and distinct subjects of each label."""
    return edges.groupBy("label").agg(
        F.count("*").alias("edges"), F.count_distinct(F.struct("graph", "src", "src_file")).alias("subjects")
    )


def unused_functions(symbols: DataFrame, called: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Functions nothing calls, that are no entry points, tests or implementations, with a confidence.

    ``symbols``: graph, name, file, kind, language; ``called`` and
    ``interfaces``: graph, name, file.
    """
    keys = ["graph", "name", "file"]
    open_ = symbols.where(
        F.col("kind").isin(*CALLABLE) & ~is_entry_point(F.col("name")) & ~is_test_file(F.col("file"))
    ).join(called, keys, "left_anti").join(interfaces, keys, "left_anti")
    confidence = (
        F.when(~is_exported(F.col("name"), F.col("language")), "high").when(F.col("kind") == "function", "medium").otherwise("low")
    )
    return open_.select(*keys, "kind", confidence.alias("confidence"))


# Factors by which names and files make a function less likely to be dead, first match wins.
NAME_FACTORS = (
    (r"^main$", 0.05), (r"^Test", 0.1), (r"^test_", 0.1), (r"^(?:setup_|teardown_)", 0.2), (r"^(?:example_|Example)", 0.2), (r"^Benchmark", 0.2),
)
FILE_FACTORS = (
    (r"_test\.go|_test\.py", 0.1), (r"/test/|/tests/", 0.15), (r"evaluation/", 0.25), (r"examples/", 0.25), (r"/scripts/", 0.3), (r"benchmark", 0.2),
)


def _factor(value: Column, factors: tuple[tuple[str, float], ...]) -> Column:
    found = F.lit(1.0)
    for pattern, factor in reversed(factors):
        found = F.when(value.rlike(pattern), factor).otherwise(found)
    return found


def dead_code_prior(symbols: DataFrame, called: DataFrame) -> DataFrame:
    """``graph, name, file, prior``: functions nothing calls, by factors of name and file times complexity, the likeliest of each graph.

    ``symbols``: graph, name, file, kind, complexity; ``called``: graph, name,
    file.  Of n symbols of a graph n / 60 functions are kept, 50 at least and 200 at most.
    """
    keys = ["graph", "name", "file"]
    sizes = symbols.groupBy("graph").agg(F.count("*").alias("n"))
    orphans = symbols.where(F.col("kind") == "function").join(called, keys, "left_anti")
    prior = _factor(F.col("name"), NAME_FACTORS) * _factor(F.col("file"), FILE_FACTORS) * F.coalesce(F.col("complexity").cast("double"), F.lit(0.0))
    scored = orphans.select(*keys, F.round(prior, 6).alias("prior"))
    order = Window.partitionBy("graph").orderBy(F.desc("prior"), "name", "file")
    placed = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 200).join(sizes, "graph")
    limit = F.least(F.lit(200), F.greatest(F.lit(50), F.floor(F.col("n") / 60)))
    return placed.where(F.col("place") <= limit).select(*keys, "prior")


def dead_code_probability(raw: Column) -> Column:
    """A relevance logit as a probability."""
    return stats.sigmoid(raw)


def nearest_homes(asked: DataFrame, homes: DataFrame) -> DataFrame:
    """``repo, name, file, home``: for each name that a file asks for (repo, name, file) the home (repo, name, home) that lies nearest.

    The same file, else one in the same folder, else one that shares most
    leading folders; ties go to the smallest path.  Homes are summed by name and
    leading folder first, so that a name with many homes and many callers meets
    once for each folder above a caller, never each with each.
    """
    from cartolith.sources.tables import package_of

    asked = asked.select("repo", "name", "file").distinct()
    homes = homes.select("repo", "name", "home").where("home IS NOT NULL").distinct()

    def above(file: str) -> Column:
        parts = F.split(package_of(F.col(file)), "/")
        return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))

    same_file = homes.select("repo", "name", F.col("home").alias("file"), F.lit(True).alias("_own"))
    folder = homes.groupBy("repo", "name", package_of(F.col("home")).alias("folder")).agg(F.min("home").alias("_near"))
    shared = homes.select("repo", "name", "home", F.explode(above("home")).alias("folder")).groupBy("repo", "name", "folder").agg(F.min("home").alias("home"))
    far = asked.select("repo", "name", "file", F.explode(above("file")).alias("folder")).join(shared, ["repo", "name", "folder"])
    depth = F.when(F.col("folder") == "", 0).otherwise(F.length("folder"))
    far = far.groupBy("repo", "name", "file").agg(F.max_by("home", depth).alias("_far"))
    found = asked.join(far, ["repo", "name", "file"]).join(same_file, ["repo", "name", "file"], "left")
    found = found.withColumn("folder", package_of(F.col("file"))).join(folder, ["repo", "name", "folder"], "left")
    return found.select("repo", "name", "file", F.when(F.col("_own"), F.col("file")).otherwise(F.coalesce("_near", "_far")).alias("home"))


def resolve_callees(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call sites (repo, caller_file, callee) with the file their callee is defined in, the nearest one (``nearest_homes``)."""
    asked = calls.select("repo", F.col("callee").alias("name"), F.col("caller_file").alias("file"))
    homes = symbols.select("repo", "name", F.col("file").alias("home"))
    return nearest_homes(asked, homes).select("repo", F.col("file").alias("caller_file"), F.col("name").alias("callee"), F.col("home").alias("callee_file"))


def reference_graph(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``repo, src, dst, weight``: file to file, each called name sharing weight 1 among the files that define it."""
    homes = symbols.select("repo", F.col("name").alias("callee"), F.col("file").alias("dst")).distinct()
    counts = homes.groupBy("repo", "callee").agg(F.count("*").alias("n"))
    joined = calls.select("repo", F.col("caller_file").alias("src"), "callee").join(homes, ["repo", "callee"]).join(counts, ["repo", "callee"])
    return joined.where("src <> dst").groupBy("repo", "src", "dst").agg(F.round(F.sum(1 / F.col("n")), 6).alias("weight"))


def tests_of(symbols: DataFrame) -> DataFrame:
    """Test symbols with the symbol of the same repository that their name points at."""
    target = F.when(F.col("name").rlike("^Test[A-Z_]"), F.regexp_replace("name", "^Test_?", "")).when(
        F.col("name").rlike("^test_"), F.regexp_replace("name", "^test_", "")
    )
    tests = symbols.select("repo_key", F.col("name").alias("test"), F.lower(target).alias("key")).where(F.col("key").isNotNull())
    return tests.join(symbols.select("repo_key", "name", F.lower("name").alias("key")), ["repo_key", "key"]).select(
        "repo_key", "test", "name"
    ).distinct()


def symbol_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``name, kind, side``: what only one of two symbol lists has, and what both have (X9 counts these)."""
    left = a.select("name", "kind").distinct().withColumn("in_a", F.lit(1))
    right = b.select("name", "kind").distinct().withColumn("in_b", F.lit(1))
    side = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").otherwise("both")
    return left.join(right, ["name", "kind"], "full_outer").select("name", "kind", side.alias("side"))


#: Least similarity of names, signatures and vectors of matched symbols, and least overlap of their bodies.
LEAST_NAME, LEAST_SIGNATURE, LEAST_VECTOR, LEAST_OVERLAP = 0.7, 0.85, 0.75, 0.15


def _one_to_one(candidates: DataFrame) -> DataFrame:
    """A maximal one-to-one choice of (a_id, b_id, score): rounds of pairs that are each other's best, until none is left.

    Ties go to the smaller ids, so that every round takes at least the best
    pair of all; a round is two aggregates and two anti-joins.
    """
    left, chosen = cut_lineage(candidates, "match-candidates"), None
    while not left.isEmpty():
        best_a = left.groupBy("a_id").agg(F.min_by("b_id", F.struct(-F.col("score"), "b_id")).alias("b_id"))
        best_b = left.groupBy("b_id").agg(F.min_by("a_id", F.struct(-F.col("score"), "a_id")).alias("a_id"))
        taken = cut_lineage(left.join(best_a, ["a_id", "b_id"]).join(best_b, ["a_id", "b_id"]), "match-round")
        chosen = taken if chosen is None else chosen.unionByName(taken)
        left = left.join(taken.select("a_id"), "a_id", "left_anti").join(taken.select("b_id"), "b_id", "left_anti")
        left = cut_lineage(left, "match-candidates")
    return left if chosen is None else chosen


def edit_candidates(a: DataFrame, b: DataFrame, least: float, gram: int = 2) -> DataFrame:
    """``a_id, b_id, score``: pairs of (id, kind, text) of one kind whose edit similarity is ``least`` or more; no pair is lost.

    d edits touch at most ``gram`` * d grams, so that of its grams in order of
    rarity the first ``gram`` * d + 1 of each text must have one in common.
    Only these are joined on; equal grams of a text are told apart by number.
    The similarity is 1 less the distance over the longer length; texts too
    short to have a gram in common for certain only meet if they are equal.
    """

    def grams(rows: DataFrame) -> DataFrame:
        all_ = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - gram + 1)), lambda i: F.substring("text", i, F.lit(gram)))
        numbered = F.transform(all_, lambda g, i: F.concat(g, F.lit("\0"), F.size(F.filter(F.slice(all_, 1, i), lambda x: x == g)).cast("string")))
        return rows.where(F.col("id").isNotNull() & (F.length("text") > 0)).select(
            "id", "kind", F.length("text").alias("n"), F.floor((1 - least) / least * F.length("text") + 1e-9).alias("far"), F.explode(numbered).alias("token")
        )

    both = grams(a).withColumn("side", F.lit(0)).unionByName(grams(b).withColumn("side", F.lit(1)))
    both = cut_lineage(both, "match-grams")
    rarity = both.groupBy("token").agg(F.count("*").alias("df"))
    order = Window.partitionBy("side", "id").orderBy("df", "token")
    first = both.join(rarity, "token").withColumn("at", F.row_number().over(order)).where(F.col("at") <= gram * F.col("far") + 1)
    first = cut_lineage(first.select("side", "id", "kind", "n", "token"), "match-prefixes")
    left = first.where("side = 0").select(F.col("id").alias("a_id"), "kind", F.col("n").alias("na"), "token")
    right = first.where("side = 1").select(F.col("id").alias("b_id"), "kind", F.col("n").alias("nb"), "token")
    met = left.join(right, ["kind", "token"]).where(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9).select("a_id", "b_id").distinct()
    joined = met.join(a.select(F.col("id").alias("a_id"), F.col("text").alias("ta")), "a_id").join(
        b.select(F.col("id").alias("b_id"), F.col("text").alias("tb")), "b_id"
    )
    return joined.select("a_id", "b_id", F.round(name_similarity(F.col("ta"), F.col("tb")), 6).alias("score")).where(F.col("score") >= least)


def token_overlap(a: Column, b: Column) -> Column:
    """Common identifiers of two texts, each as often as both have it, over those of the shorter list; 0 if one has none."""

    def numbered(text: Column) -> Column:
        words = F.array_sort(F.regexp_extract_all(text, F.lit(r"[A-Za-z_]\w*"), F.lit(0)))
        return F.transform(words, lambda x, i: F.concat(x, F.lit("\0"), (i - F.array_position(words, x)).cast("string")))

    left, right = numbered(a), numbered(b)
    smaller = F.least(F.size(left), F.size(right))
    return F.when(smaller > 0, F.size(F.array_intersect(left, right)) / smaller).otherwise(0.0)


def greedy_matches(a: DataFrame, b: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """``a_id, b_id, how, score``: symbols of two lists matched one to one, and those left over.

    ``a`` and ``b``: id, name, kind, file, signature, body, body_hash.  Stages,
    each among what is left of the one before: equal name and kind (``exact``,
    ``modified`` if the bodies' hashes differ, ``moved`` if only the files do),
    similar names whose bodies have identifiers in common (``fuzzy``), similar
    signatures (``renamed``, nearer to 1 if the hashes agree), near vectors
    (``semantic``: a_id, b_id, score of ``near``).  What is left is a ``gap``.
    Equal symbols go in order of id; the other stages take rounds of pairs that
    are each other's best rather than one scan in order.
    """
    order = Window.partitionBy("name", "kind").orderBy("id")
    a, b = (cut_lineage(x.select("id", "name", "kind", "file", "signature", "body", "body_hash").where("id IS NOT NULL"), "match-side") for x in (a, b))
    left, right = (x.withColumn("k", F.row_number().over(order)) for x in (a, b))

    def side(rows: DataFrame, s: str) -> DataFrame:
        return rows.select("name", "kind", "k", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "file", "body_hash")])

    hashed = (F.coalesce("a_body_hash", F.lit(0)) != 0) & (F.coalesce("b_body_hash", F.lit(0)) != 0)
    how = F.when(hashed & (F.col("a_body_hash") != F.col("b_body_hash")), "modified").when(
        hashed & (F.col("a_file") != F.col("b_file")), "moved"
    ).otherwise("exact")
    found = side(left, "a").join(side(right, "b"), ["name", "kind", "k"]).select("a_id", "b_id", how.alias("how"), F.lit(1.0).alias("score"))
    found = cut_lineage(found, "match-exact")

    def rest(done: DataFrame) -> tuple[DataFrame, DataFrame]:
        return tuple(x.join(done.select(F.col(c).alias("id")), "id", "left_anti") for x, c in ((a, "a_id"), (b, "b_id")))

    def stage(pairs: DataFrame, name: str) -> DataFrame:
        return found.unionByName(_one_to_one(pairs).select("a_id", "b_id", F.lit(name).alias("how"), "score"))

    def texts(rows: DataFrame, column: str) -> DataFrame:
        return rows.select("id", "kind", F.col(column).alias("text"))

    def both(pairs: DataFrame, columns: list[str]) -> DataFrame:
        for rows, s in ((a, "a"), (b, "b")):
            pairs = pairs.join(rows.select(F.col("id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in columns]), f"{s}_id")
        return pairs

    ra, rb = rest(found)
    named = both(edit_candidates(texts(ra, "name"), texts(rb, "name"), LEAST_NAME), ["body"])
    bodies = (F.coalesce(F.length("a_body"), F.lit(0)) > 0) & (F.coalesce(F.length("b_body"), F.lit(0)) > 0)
    named = named.where(~bodies | (token_overlap(F.col("a_body"), F.col("b_body")) >= LEAST_OVERLAP)).select("a_id", "b_id", "score")
    found = cut_lineage(stage(named, "fuzzy"), "match-fuzzy")
    ra, rb = rest(found)
    signed = both(edit_candidates(texts(ra, "signature"), texts(rb, "signature"), LEAST_SIGNATURE, 3), ["body_hash"])
    agree = hashed & (F.col("a_body_hash") == F.col("b_body_hash"))
    signed = signed.select("a_id", "b_id", F.when(agree, (F.col("score") + 1) / 2).otherwise(F.col("score")).alias("score"))
    found = cut_lineage(stage(signed, "renamed"), "match-renamed")
    if near is not None:
        ra, rb = rest(found)
        close = near.where(F.col("score") >= LEAST_VECTOR).join(ra.select(F.col("id").alias("a_id")), "a_id", "left_semi")
        found = cut_lineage(stage(close.join(rb.select(F.col("id").alias("b_id")), "b_id", "left_semi").select("a_id", "b_id", "score"), "semantic"), "match-semantic")
    ra, rb = rest(found)
    gap = [F.lit("gap").alias("how"), F.lit(0.0).alias("score")]
    kind = dict(a.dtypes)["id"]
    only_a = ra.select(F.col("id").alias("a_id"), F.lit(None).cast(kind).alias("b_id"), *gap)
    only_b = rb.select(F.lit(None).cast(kind).alias("a_id"), F.col("id").alias("b_id"), *gap)
    return found.unionByName(only_a).unionByName(only_b)


def match_breakdown(matches: DataFrame) -> DataFrame:
    """``how, side, matches``: matches of each kind; gaps by the side that has no counterpart."""
    side = F.when(F.col("how") != "gap", "both").when(F.col("b_id").isNull(), "only_a").otherwise("only_b")
    return matches.groupBy("how", side.alias("side")).agg(F.count("*").alias("matches"))
