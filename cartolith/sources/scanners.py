"""Scanners that turn raw text into rows: histories, diffs, metrics, traces, manifests, documents, symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions import complexity
from cartolith.functions.predicates import BINARY, contains_any, is_ignored, language_of, matches_glob
from cartolith.sources.tables import package_of

# Code by which a layer's sources tell its role; the first role with a match wins.
ROLES = (
    ("server", (
        "http.ListenAndServe", "http.Serve", "http.Server{", "http.ServeMux", "http.HandleFunc", "gin.Default", "echo.New", "chi.NewRouter",
        "mux.HandleFunc", "express()", "fastify()", "Hono(", "createServer(", "Flask(__name__)", "FastAPI()", "Django", "uvicorn.run",
        "SpringApplication.run", "SpringBootApplication", "HttpServer::new", "axum::Router", "rocket::build", "Sinatra::Base", "Rails.application",
        "WebApplication.CreateBuilder", "Host.CreateDefaultBuilder",
    )),
    ("client", (
        "ReactDOM", "createRoot", "document.querySelector", "document.getElementById", "fetch(", "axios.", "XMLHttpRequest", "Vue.createApp",
        "createApp(", "angular.module",
    )),
    ("worker", ("import torch", "import tensorflow", "from sklearn", "import pandas", "torch.nn", "tf.keras", "model.fit", "model.train")),
)


def walk_files(spark: SparkSession, folder: str, max_bytes: int = 1_000_000, ignore: list[str] | None = None, most: int | None = None) -> DataFrame:
    """``path, size, language, content, skipped``: all files below a folder; ``skipped`` says why content is null.

    ``ignore`` are patterns in the manner of ignore files; of the rest the
    first ``most`` by path are kept and the others skipped as ``count``.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.regexp_replace(F.lit(folder.rstrip("/")), r"^file:/*", "/")
    path = F.expr("substring(path, locate(root, path) + length(root) + 1)")
    rows = raw.withColumn("root", root).select(path.alias("path"), F.col("length").alias("size"), "modificationTime", "content")
    reason = (
        F.when(is_ignored(F.col("path")) | gitignored(F.col("path"), ignore or []), "ignored")
        .when(F.col("path").rlike(BINARY), "binary")
        .when(F.col("size") > max_bytes, "oversize")
    )
    if most is not None:
        kept = rows.where(reason.isNull()).select("path").orderBy("path").limit(most).withColumn("_kept", F.lit(True))
        rows = rows.join(kept, "path", "left")
        reason = F.coalesce(reason, F.when(F.col("_kept").isNull(), "count"))
    return rows.select(
        "path", "size", F.col("modificationTime").alias("mod_time"), language_of(F.col("path")).alias("language"),
        F.when(reason.isNull(), F.decode("content", "UTF-8")).alias("content"), reason.alias("skipped"),
    )


def focused(files: DataFrame, focus: str | None) -> DataFrame:
    """Files that a focus names: a glob, a folder, or words of which any occurs in the path."""
    if not focus:
        return files
    if any(c in focus for c in "*?"):
        return files.where(matches_glob(F.col("path"), focus))
    if "/" in focus:
        return files.where(F.startswith("path", F.lit(focus.rstrip("/") + "/")))
    return files.where(contains_any(F.col("path"), focus.split()))


def gitignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches is not negated; a trailing slash names a folder, a leading one anchors."""
    verdict = F.lit(False)
    for raw in patterns:
        pattern = raw.strip()
        if not pattern or pattern.startswith("#"):
            continue
        negated, pattern = pattern.startswith("!"), pattern.lstrip("!")
        anchored, folder = pattern.startswith("/") or "/" in pattern.rstrip("/"), pattern.endswith("/")
        body = pattern.strip("/")
        from cartolith.functions.predicates import glob_pattern

        core = glob_pattern(body)[1:-1]
        regex = ("^" if anchored else "(?:^|/)") + core + ("/" if folder else "(?:/|$)")
        verdict = F.when(path.rlike(regex), not negated).otherwise(verdict)
    return verdict


def numstat_rows(log: DataFrame) -> DataFrame:
    """``commit_id, path, additions, deletions`` from lines (commit_id, line) of a numstat log; ``-`` counts 0, renames take the new path."""
    part = F.split("line", "\t")
    path = F.regexp_replace(F.get(part, F.lit(2)), r"\{[^{}]* => ([^{}]*)\}", "$1")
    path = F.regexp_replace(F.regexp_replace(path, r"^.* => ", ""), "//+", "/")
    return log.where(F.size(part) == 3).select(
        "commit_id", path.alias("path"),
        F.coalesce(F.expr("try_cast(split(line, '\t')[0] AS BIGINT)"), F.lit(0)).alias("additions"),
        F.coalesce(F.expr("try_cast(split(line, '\t')[1] AS BIGINT)"), F.lit(0)).alias("deletions"),
    )


def renames(log: DataFrame) -> DataFrame:
    """``old_path, new_path`` of renames in numstat lines."""
    path = F.get(F.split("line", "\t"), F.lit(2))
    inside = F.regexp_replace(path, r"\{([^{}]*) => [^{}]*\}", "$1")
    old = F.regexp_replace(F.regexp_replace(inside, r" => .*$", ""), "//+", "/")
    new = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1"), r"^.* => ", ""), "//+", "/")
    return log.where(path.contains(" => ")).select(old.alias("old_path"), new.alias("new_path"))


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """``diff_id, file, start_line, end_line`` of the new side of unified diffs (diff_id, text); empty hunks are dropped.

    Each file's part starts at its header, so that its hunks carry its name
    without a window over lines.
    """
    parts = F.split("text", r"(?m)^(?=diff --git |--- a/)")
    files = diffs.select("diff_id", F.explode(parts).alias("part")).select(
        "diff_id", F.regexp_extract("part", r"(?m)^\+\+\+ b/(.*)$", 1).alias("file"), "part"
    )
    hunks = files.where("file <> ''").select(
        "diff_id", "file", F.explode(F.regexp_extract_all("part", F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+(?:,\d+)?) @@"), F.lit(1))).alias("h")
    )
    start = F.substring_index("h", ",", 1).cast("int")
    length = F.when(F.col("h").contains(","), F.substring_index("h", ",", -1).cast("int")).otherwise(1)
    return hunks.where(length > 0).select("diff_id", "file", start.alias("start_line"), (start + length - 1).alias("end_line"))


def metric_samples(responses: DataFrame) -> DataFrame:
    """``metric, labels, ts, value`` from JSON matrices (column ``json``) of a range query."""
    schema = "data struct<result: array<struct<metric: map<string, string>, values: array<array<string>>>>>"
    series = responses.select(F.explode(F.from_json("json", schema)["data"]["result"]).alias("r"))
    points = series.select("r.metric", F.explode("r.values").alias("v"))
    return points.select(
        F.col("metric")["__name__"].alias("metric"), F.map_filter("metric", lambda k, v: k != "__name__").alias("labels"),
        F.timestamp_seconds(F.col("v")[0].cast("double")).alias("ts"), F.col("v")[1].cast("double").alias("value"),
    )


def trace_spans(responses: DataFrame) -> DataFrame:
    """``trace_id, span_id, operation, start_us, duration, tags`` from JSON traces (column ``json``)."""
    tag = "struct<key: string, value: string>"
    span = f"struct<traceID: string, spanID: string, operationName: string, startTime: bigint, duration: bigint, tags: array<{tag}>>"
    spans = responses.select(F.explode(F.from_json("json", f"data array<struct<spans: array<{span}>>>")["data"]).alias("t")).select(
        F.explode("t.spans").alias("s")
    )
    tags = F.map_from_entries(F.transform(F.array_distinct(F.transform("s.tags", lambda t: t["key"])), lambda k: F.struct(
        k, F.element_at(F.filter("s.tags", lambda t: t["key"] == k), 1)["value"]
    )))
    return spans.select(
        F.col("s.traceID").alias("trace_id"), F.col("s.spanID").alias("span_id"), F.col("s.operationName").alias("operation"),
        F.col("s.startTime").alias("start_us"), F.col("s.duration").alias("duration"), tags.alias("tags"),
    )


def golden_records(lines: DataFrame) -> DataFrame:
    """``repo, query, language, expected`` from JSON lines (column ``value``); comments and blank lines are skipped."""
    schema = "repo string, query string, language string, expected_top_3 array<string>, notes string"
    kept = lines.where(~F.col("value").rlike(r"^\s*(?:#|//|$)"))
    return kept.select(F.from_json("value", schema).alias("r")).select(
        "r.repo", "r.query", "r.language", F.col("r.expected_top_3").alias("expected")
    )


def document_sections(documents: DataFrame) -> DataFrame:
    """``doc_id, section, title, body``: texts (doc_id, text) split at headings; what stands before the first has no title."""
    parts = F.split(F.regexp_replace("text", r"\r\n?", "\n"), r"(?m)^(?=#{1,6} )")
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(parts).alias("section", "part"))
    return rows.where(F.trim("part") != "").select(
        "doc_id", "section", F.nullif(F.regexp_extract("part", r"^#{1,6} ([^\n]*)", 1), F.lit("")).alias("title"),
        F.trim(F.regexp_replace("part", r"^#{1,6} [^\n]*\n?", "")).alias("body"),
    )


#: Of each ecosystem: name of the manifest, the sections that list dependencies, and one dependency in them.
MANIFESTS = (
    ("go", r"^go\.mod$", r"(?m)^require\s*\([^)]*\)|^require\s+[^(\n]+$", r"(?m)^\s*(?:require\s+)?([^\s()/]+\.[^\s()]*)\s+(v[^\s/]+)"),
    ("npm", r"^package\.json$", r"\"(?:dev|peer|optional)?[dD]ependencies\"\s*:\s*\{[^}]*\}", r"\"(@?[\w./-]+)\"\s*:\s*\"([^\"]*)\""),
    ("pypi", r"^requirements[\w.-]*\.txt$", r"(?s).+", r"(?m)^\s*([A-Za-z][\w.-]*)(?:\[[^\]]*\])?\s*(?:==|>=|~=|<=|>|<)?\s*([\w.]*)"),
    ("pypi", r"^pyproject\.toml$", r"(?m)^dependencies\s*=\s*\[[^\]]*\]", r"[\"']([A-Za-z][\w.-]*)(?:\[[^\]]*\])?\s*(?:==|>=|~=|<=|>|<)?\s*([\w.]*)"),
    ("pypi", r"^pyproject\.toml$", r"(?m)^\[tool\.poetry[\w.-]*dependencies\][^\[]*", r"(?m)^([A-Za-z][\w.-]*)\s*=\s*(?:\{[^}\n]*?version\s*=\s*)?\"([^\"]*)\""),
    ("cargo", r"^Cargo\.toml$", r"(?m)^\[(?:[^\]\n]*\.)?(?:dev-|build-)?dependencies\][^\n]*\n(?:(?!\[)[^\n]*\n?)*", r"(?m)^([\w-]+)\s*=\s*(?:\{[^}\n]*?version\s*=\s*)?\"([^\"]*)\""),
    ("maven", r"^pom\.xml$", r"(?s)<dependency>.*?</dependency>", r"(?s)<artifactId>([^<]+)</artifactId>.*?<version>([^<]+)</version>"),
    ("nuget", r"\.csproj$", r"<PackageReference[^>]*>", r"Include=\"([^\"]+)\"[^>]*\bVersion=\"([^\"]+)\""),
    ("gem", r"^Gemfile$", r"(?m)^\s*gem .*$", r"gem\s+['\"]([\w-]+)['\"](?:,\s*['\"][~>= ]*([\w.]+)['\"])?"),
)
#: Names in dependency sections that are no dependencies.
NO_DEPENDENCY = {"pypi": ("python",)}


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """``repo, path, ecosystem, name, version`` from manifests (repo, path, content): go.mod, package.json, requirements, pyproject, Cargo, pom, csproj, Gemfile.

    Only the sections that list dependencies are read, so that a package's own
    name, version or edition is none; a version range keeps its first number.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    found = None
    for ecosystem, file, section, item in MANIFESTS:
        text = F.regexp_replace(F.regexp_replace("content", r"\r\n?", "\n"), r"(?m)(?<!:)//.*$" if ecosystem == "go" else r"(?m)^\s*#.*$", "")
        own = files.where(name.rlike(file) & F.col("content").isNotNull()).select("repo", "path", F.explode(F.regexp_extract_all(text, F.lit(section), F.lit(0))).alias("s"))
        if ecosystem == "npm":
            own = own.withColumn("s", F.regexp_replace("s", r"^[^{]*", ""))
        rows = own.select("repo", "path", F.explode(F.regexp_extract_all("s", F.lit(item), F.lit(0))).alias("m")).select(
            "repo", "path", F.lit(ecosystem).alias("ecosystem"), F.regexp_extract("m", item, 1).alias("name"),
            F.nullif(F.regexp_replace(F.regexp_extract("m", item, 2), r"^[~^>=< ]+", ""), F.lit("")).alias("version"),
        ).where(~F.col("name").isin("", *NO_DEPENDENCY.get(ecosystem, ())))
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


def image_pins(files: DataFrame) -> DataFrame:
    """``repo, path, line, image, tag, unresolved`` of base and service images in Dockerfiles and compose files."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    lines = files.where(name.rlike(r"(?i)^dockerfile|^(?:docker-)?compose.*\.ya?ml$") & F.col("content").isNotNull()).select(
        "repo", "path", F.posexplode(F.split("content", "\n")).alias("at", "text")
    )
    reference = F.regexp_extract("text", r"(?i)^\s*(?:FROM\s+(?:--platform=\S+\s+)?|image:\s*[\"']?)([^\s\"'#]+)", 1)
    found = lines.select("repo", "path", (F.col("at") + 1).alias("line"), reference.alias("ref")).where("ref <> '' AND ref <> 'scratch'")
    return found.select(
        "repo", "path", "line", F.regexp_replace("ref", r":[^:/]*$|@sha256:.*$", "").alias("image"),
        F.nullif(F.regexp_extract("ref", r"(?::([^:/@]*)$|@(sha256:.*)$)", 1), F.lit("")).alias("tag"),
        F.col("ref").contains("$").alias("unresolved"),
    )


_TYPESCRIPT = r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:function|class|interface|type|const|enum)\s+(\w+)"
_CURLY = r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|partial|readonly)\s+)+(?:class|interface|enum|struct|record|[\w<>\[\], ]+)\s+(\w+)\s*[({=;:<]"
_C = r"^(?:typedef\s+)?(?:struct|enum|union|class|namespace)\s+(\w+)|^(?:(?:static|inline|extern|const|virtual|unsigned)\s+)*[A-Za-z_][\w:<>]*[\s*&]+(?:[A-Za-z_]\w*::)*~?([A-Za-z_]\w*)\s*\([^;]*$"
#: How a line of each language defines a symbol; its name is the group that matches.
DEFINITIONS = {
    "go": r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+|const\s+|var\s+)(\w+)",
    "python": r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)",
    "typescript": _TYPESCRIPT,
    "javascript": _TYPESCRIPT,
    "svelte": _TYPESCRIPT,
    "vue": _TYPESCRIPT,
    "astro": _TYPESCRIPT,
    "java": _CURLY,
    "csharp": _CURLY,
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?:fn|struct|enum|trait|const|static|type|mod)\s+(\w+)",
    "ruby": r"^\s*(?:def\s+(?:self\.)?|class\s+|module\s+)(\w+)",
    "php": r"^\s*(?:(?:abstract|final|public|private|protected|static)\s+)*(?:function|class|interface|trait|const)\s+&?(\w+)",
    "kotlin": r"^\s*(?:(?:public|private|internal|protected|open|override|suspend|data|sealed|abstract|inline|enum)\s+)*(?:fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?|class\s+|interface\s+|object\s+|val\s+|var\s+)(\w+)",
    "swift": r"^\s*(?:(?:public|private|internal|fileprivate|open|static|final|override|mutating)\s+)*(?:func|class|struct|enum|protocol|extension|let|var)\s+(\w+)",
    "c": _C,
    "cpp": _C,
}
# Words that stand before a bracket without being called.
NOT_CALLED = "if for while switch catch return func function def fn fun class struct sizeof typeof match when elif except lambda and or not in is await new throw".split()


def extract_symbols(files: DataFrame) -> DataFrame:
    """``repo, file, line, name, kind, signature`` by one pattern a language; a symbol is a line that defines it.

    Patterns are tried line by line in the JVM, so that a file of any length is exploded, never held as rows by Python.
    """
    lines = files.where(F.col("content").isNotNull()).select(
        "repo", F.col("path").alias("file"), F.coalesce("language", language_of(F.col("path"))).alias("language"),
        F.posexplode(F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n")).alias("at", "text"),
    )
    name = F.lit("")
    for language, pattern in DEFINITIONS.items():
        found = F.regexp_extract("text", pattern, 1)
        if "|^" in pattern:
            found = F.coalesce(F.nullif(found, F.lit("")), F.regexp_extract("text", pattern, 2))
        name = F.when(F.col("language") == language, found).otherwise(name)
    kind = (
        F.when(F.col("text").rlike(r"\bfunc\s+\("), "method")
        .when(F.col("text").rlike(r"^\s+(?:async\s+)?def\b|^\s+(?:pub\s+)?fn\b|^\s+(?:[a-z]+\s+)*(?:func|fun|function)\b"), "method")
        .when(F.col("text").rlike(r"\b(?:func|fun|def|function|fn)\b"), "function")
        .when(F.col("text").rlike(r"\b(?:struct|class|record|union)\b"), "struct")
        .when(F.col("text").rlike(r"\b(?:interface|trait|protocol)\b"), "interface")
        .when(F.col("text").rlike(r"\("), "method")
        .otherwise("const")
    )
    return lines.select(
        "repo", "file", (F.col("at") + 1).alias("line"), name.alias("name"), kind.alias("kind"), F.trim("text").alias("signature")
    ).where("name <> ''")


def call_rows(files: DataFrame) -> DataFrame:
    """``repo, file, line, callee, receiver`` of names before a bracket in files (repo, path, language, content), not where they are defined.

    Comments and what strings hold are no calls.
    """
    language = F.coalesce("language", language_of(F.col("path")))
    code = complexity.without_strings(complexity.without_comments(F.regexp_replace("content", r"\r\n?", "\n"), language))
    lines = files.where(F.col("content").isNotNull() & language.isin(*DEFINITIONS)).select("repo", F.col("path").alias("file"), F.posexplode(F.split(code, "\n")).alias("at", "text"))
    call = r"(?:([A-Za-z_$][\w$]*)\s*(?:\.|::|->)\s*)?([A-Za-z_$][\w$]*)\("
    defined = r"\b(?:func|function|def|fn|fun|class)\s+(?:\([^)]*\)\s*)?(?:self\.)?[\w$.]+\("
    bare = F.regexp_replace("text", defined, " ")
    found = lines.select("repo", "file", (F.col("at") + 1).alias("line"), F.explode(F.regexp_extract_all(bare, F.lit(call), F.lit(0))).alias("m"))
    return found.select(
        "repo", "file", "line", F.regexp_extract("m", call, 2).alias("callee"), F.nullif(F.regexp_extract("m", call, 1), F.lit("")).alias("receiver")
    ).where(~F.col("callee").isin(*NOT_CALLED))


def type_relations(files: DataFrame) -> DataFrame:
    """``repo, file, line, subject, target, kind``: what classes and types extend or implement, by the words of their language."""
    lines = files.where("content IS NOT NULL").select("repo", F.col("path").alias("file"), F.posexplode(F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n")).alias("at", "text"))
    subject = F.regexp_extract("text", r"\b(?:class|interface|struct|trait)\s+(\w+)", 1)
    names = r"((?:[\w.]+(?:<[^>]*>)?)(?:\s*,\s*[\w.]+(?:<[^>]*>)?)*)"
    rules = (
        ("extends", subject, rf"\bextends\s+{names}"), ("implements", subject, rf"\bimplements\s+{names}"), ("extends", subject, r"^\s*class\s+\w+\(([\w., ]+)\)\s*:"),
        ("extends", subject, r"\bclass\s+\w+\s*(?:<|:)\s*([\w.]+)\s*(?:$|\{|,|\()"), ("implements", F.regexp_extract("text", r"\bimpl(?:<[^>]*>)?\s+[\w:]+(?:<[^>]*>)?\s+for\s+(\w+)", 1), r"\bimpl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s"),
    )
    parts = [_relations(kind, own, pattern) for kind, own, pattern in rules]
    found = lines.select("repo", "file", (F.col("at") + 1).alias("line"), F.inline(F.array_distinct(F.concat(*parts))))
    return found.where("subject <> '' AND target NOT IN ('', 'object')").distinct()


def _relations(kind: str, own: Column, pattern: str) -> Column:
    targets = F.filter(F.split(F.regexp_extract("text", pattern, 1), ","), lambda t: F.trim(t) != "")
    return F.transform(targets, lambda t: F.struct(own.alias("subject"), F.regexp_replace(F.trim(t), "<.*$", "").alias("target"), F.lit(kind).alias("kind")))


def import_rows(files: DataFrame) -> DataFrame:
    """``repo, file, target`` of import statements."""
    lines = files.where(F.col("content").isNotNull()).select(
        "repo", F.col("path").alias("file"), F.explode(F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n")).alias("text")
    )
    target = F.regexp_extract(
        "text", r"^\s*(?:import\s+(?:\w+\s+)?\"([^\"]+)\"|import\s+.*from\s+[\"']([^\"']+)[\"']|(?:import|from)\s+([\w.]+)|use\s+([\w:]+))", 0
    )
    bare = F.regexp_replace(target, r"^\s*(?:import\s+.*from\s+|import\s+(?:\w+\s+)?(?=\")|import\s+|from\s+|use\s+)|[\"']", "")
    return lines.select("repo", "file", bare.alias("target")).where("target <> ''").distinct()


def layer_role(sources: Column) -> Column:
    """Role of a layer by its sources (an array of texts): server, client, worker, or library without any sign."""
    role = F.lit("library")
    for name, signals in reversed(ROLES):
        role = F.when(F.exists(sources, lambda x: reduce(lambda a, b: a | b, [x.contains(sign) for sign in signals])), name).otherwise(role)
    return role


def detected_layers(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """``repo, path, layer, role``: the nearest folder with a manifest (repo, path) owns a file (repo, path, content).

    The role of a layer is the first that any of its own files shows; signs are
    looked for file by file and only their ranks are combined.
    """
    roots = manifests.select("repo", package_of(F.col("path")).alias("layer")).distinct()
    folders = files.select("repo", "path", F.split(package_of(F.col("path")), "/").alias("f")).distinct().select(
        "repo", "path", F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.size("f")), lambda n: F.array_join(F.slice("f", 1, n), "/")), F.array(F.lit(".")))).alias("layer")
    ).distinct()
    best = F.struct(F.when(F.col("layer") == ".", 0).otherwise(F.length("layer")), "layer")
    owned = folders.join(roots, ["repo", "layer"]).groupBy("repo", "path").agg(F.max(best).alias("b")).select("repo", "path", "b.layer")
    order = [name for name, _ in ROLES] + ["library"]
    sign = F.array_position(F.array(*map(F.lit, order)), layer_role(F.array(F.coalesce("content", F.lit("")))))
    shown = owned.join(files.select("repo", "path", sign.alias("sign")), ["repo", "path"]).groupBy("repo", "layer").agg(F.min("sign").alias("sign"))
    roles = shown.select("repo", "layer", F.element_at(F.array(*map(F.lit, order)), F.col("sign").cast("int")).alias("role"))
    return owned.join(roles, ["repo", "layer"]).select("repo", "path", "layer", "role")


def assigned_layers(files: DataFrame, layers: DataFrame) -> DataFrame:
    """``repo, path, layer``: the first layer (repo, layer, root, place) in the order of ``place`` whose root is a folder above the file; ``.`` is above all."""
    folders = files.select("repo", "path", F.split("path", "/").alias("f")).distinct().select(
        "repo", "path", F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.size("f")), lambda n: F.array_join(F.slice("f", 1, n), "/")), F.array(F.lit(".")))).alias("root")
    )
    own = layers.select("repo", "layer", F.coalesce(F.nullif(F.rtrim(F.col("root"), F.lit("/")), F.lit("")), F.lit(".")).alias("root"), "place")
    return folders.join(own, ["repo", "root"]).groupBy("repo", "path").agg(F.min_by("layer", F.struct("place", "layer")).alias("layer"))


def skip_counts(walked: DataFrame) -> DataFrame:
    """``reason, files``: how many files of a walk were skipped for each reason, ``kept`` for the rest."""
    return walked.groupBy(F.coalesce("skipped", F.lit("kept")).alias("reason")).agg(F.count("*").alias("files"))


def content_focused(files: DataFrame, words: list[str]) -> DataFrame:
    """Files (repo, path, content) in which an identifier has any of the words as a part, in any case."""
    wanted = F.array(*[F.lit(w.lower()) for w in words])
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(r"[a-z_]\w*"), F.lit(0)))
    return files.where(F.exists(tokens, lambda t: F.exists(wanted, lambda w: F.instr(t, w) > 0)))
