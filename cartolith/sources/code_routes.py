"""Routes that source code serves or calls, by patterns of each language, and what they prove about two files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ways to declare or call a route; groups: what names the method and the path, in the order given.
_STRING = r"[\"'`]([^\"'`\n]+)[\"'`]"
_VERBS = r"(get|post|put|patch|delete|options|head)"
#: Languages, side, framework, pattern, group of the method (0: any), group of the path, group of the handler (0: none).
PATTERNS = (
    (("go",), "server", "net/http", r"(?:http\.)?(?:HandleFunc|Handle)\(\s*\"([^\"]+)\"\s*,\s*([A-Za-z_][\w.]*)\s*\)", 0, 1, 2),
    (("go",), "server", "router", r"\w+\.(Get|Post|Put|Patch|Delete|Options|Head|GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\(\s*\"([^\"]+)\"\s*,\s*([A-Za-z_][\w.]*)\s*\)", 1, 2, 3),
    (("go",), "client", "net/http", r"http\.(Get|Post|Head)\(\s*\"([^\"]+)\"", 1, 2, 0),
    (("go",), "client", "net/http", r"http\.NewRequest(?:WithContext)?\([^,\"]*,?\s*\"([A-Z]+)\"\s*,\s*\"([^\"]+)\"\s*[,)]", 1, 2, 0),
    (("typescript", "javascript", "svelte", "vue", "astro"), "server", "express", r"\b(?:app|router|server|api)\." + _VERBS + r"\(\s*" + _STRING + r"(?:\s*,\s*([A-Za-z_$][\w$.]*)\s*\))?", 1, 2, 3),
    (("typescript",), "server", "nest", r"@(Get|Post|Put|Patch|Delete|Options|Head)\(\s*" + _STRING + r"\s*\)", 1, 2, 0),
    (("typescript", "javascript", "svelte", "vue", "astro", "html"), "client", "fetch", r"\bfetch\(\s*" + _STRING, 0, 1, 0),
    (("typescript", "javascript", "svelte", "vue", "astro"), "client", "axios", r"\baxios\." + _VERBS + r"\(\s*" + _STRING, 1, 2, 0),
    (("python",), "server", "flask", r"@\w+\.route\(\s*" + _STRING, 0, 1, 0),
    (("python",), "server", "fastapi", r"@\w+\." + _VERBS + r"\(\s*" + _STRING, 1, 2, 0),
    (("python",), "client", "requests", r"\b(?:requests|httpx|client|session)\." + _VERBS + r"\(\s*f?" + _STRING, 1, 2, 0),
    (("java", "kotlin"), "server", "spring", r"@(Get|Post|Put|Patch|Delete)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]+)\"", 1, 2, 0),
    (("java", "kotlin"), "server", "spring", r"@RequestMapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]+)\"", 0, 1, 0),
    (("csharp",), "server", "aspnet", r"\[Http(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]+)\"", 1, 2, 0),
    (("csharp",), "server", "minimal", r"\.Map(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]+)\"", 1, 2, 0),
    (("ruby",), "server", "sinatra", r"(?m)^\s*(get|post|put|patch|delete)\s+['\"]([^'\"]+)['\"]", 1, 2, 0),
    (("rust",), "server", "macro", r"#\[(get|post|put|patch|delete)\(\s*\"([^\"]+)\"", 1, 2, 0),
    (("rust",), "server", "axum", r"\.route\(\s*\"([^\"]+)\"\s*,\s*(?:web::)?" + _VERBS + r"\(\s*([A-Za-z_][\w:]*)?", 2, 1, 3),
    (("html", "svelte", "vue", "astro", "php"), "client", "htmx", r"\bhx-" + _VERBS + r"=\"([^\"]+)\"", 1, 2, 0),
    (("html", "svelte", "vue", "astro", "php"), "client", "form", r"<form[^>]*\baction=\"([^\"]+)\"", 0, 1, 0),
    (("php",), "server", "hook", r"\badd_(?:action|filter)\(\s*['\"]([\w/-]+)['\"]\s*,\s*['\"]?([\w:]*)", 0, 1, 2),
    (("php",), "client", "hook", r"\b(?:do_action|apply_filters)\(\s*['\"]([\w/-]+)['\"]", 0, 1, 0),
)
# Header names that look like a path of one segment.
HEADERS = (
    "accept accept-encoding accept-language authorization cache-control connection content-encoding content-length content-type cookie date etag "
    "expires host if-match if-modified-since if-none-match last-modified location origin pragma range referer server set-cookie transfer-encoding "
    "upgrade user-agent vary via www-authenticate x-forwarded-for x-forwarded-proto x-real-ip x-request-id x-requested-with"
).split()
GENERIC = ("/", "/health", "/healthz", "/ready", "/readyz", "/live", "/livez", "/metrics", "/ping", "/status", "/version", "/favicon.ico", "/robots.txt")


def route_path(raw: Column) -> Column:
    """A path without host, query and fragment; parameters of any notation are ``*``; single slashes, none at the end."""
    p = F.regexp_replace(raw, r"^[a-zA-Z][\w+.-]*://[^/]*", "")
    p = F.regexp_replace(p, r"#.*$", "")
    p = F.regexp_replace(p, r"\$\{[^}]*\}|\{[^}]*\}|<[^>]*>", "*")
    p = F.regexp_replace(p, r"/:[A-Za-z_]\w*\??", "/*")
    p = F.regexp_replace(F.regexp_replace(p, "^(?!/)", "/"), "/{2,}", "/")
    return F.regexp_replace(p, "(?<=.)/$", "")


def is_junk_path(path: Column) -> Column:
    """A query fragment, or one segment that is a header's name, one character or a long hexadecimal number."""
    segment = F.regexp_replace(path, "^/", "")
    single = ~segment.contains("/") & (segment != "")
    odd = F.lower(segment).isin(*HEADERS) | (F.length(segment) == 1) & (segment != "*") | segment.rlike("^[0-9a-fA-F]{24,}$")
    return path.contains("?") | (single & odd)


def _matches(text: Column, rule: tuple) -> Column:
    """What one pattern finds in a text: an array of line, method, path, handler, side, framework."""
    _, side, framework, pattern, method, path, handler = rule
    # the text is cut before each match, so that the line ends before it can be counted
    parts = F.split(text, f"(?={pattern.replace('(?m)^', '(?<![^\n])')})", -1)

    def lines(x: Column) -> Column:
        return F.length(x) - F.length(F.translate(x, "\n", ""))

    def one(part: Column, at: Column) -> Column:
        line = F.aggregate(F.slice(parts, F.lit(1), at), F.lit(1), lambda s, x: s + lines(x))
        if "(?m)^" in pattern:
            line = line + lines(F.regexp_extract(part, r"^\s*", 0))
        raw = F.regexp_extract(part, pattern, path)
        verb = F.upper(F.regexp_extract(part, pattern, method)) if method else F.lit("*")
        if framework == "net/http" and side == "server":
            verb = F.coalesce(F.nullif(F.regexp_extract(raw, r"^([A-Z]+)\s+", 1), F.lit("")), F.lit("*"))
            raw = F.regexp_replace(F.regexp_replace(raw, r"^[A-Z]+\s+", ""), r"^[^/]+(?=/)", "")
        named = F.nullif(F.regexp_extract(part, pattern, handler), F.lit("")) if handler else F.lit(None).cast("string")
        begins = F.startswith(part, F.regexp_extract(part, pattern, 0)) & (raw != "")
        return F.when(begins, F.struct(
            line.alias("line"), verb.alias("method"), (raw if framework == "hook" else route_path(raw)).alias("path"), named.alias("handler"),
            F.lit(side).alias("side"), F.lit(framework).alias("framework"),
        ))

    return F.filter(F.transform(parts, one), lambda x: x.isNotNull())


def code_routes(files: DataFrame) -> DataFrame:
    """``repo, file, line, method, path, handler, side, framework`` of routes in files (repo, path, language, content).

    Every pattern of a file's language is tried over its text, in one pass over
    the files; a match's line is one more than the line ends before it.  Junk
    paths are left out; a hook keeps its name as path.
    """
    text = F.regexp_replace("content", r"\r\n?", "\n")
    known = sorted({language for rule in PATTERNS for language in rule[0]})
    own = files.where(F.col("language").isin(*known) & F.col("content").isNotNull()).select("repo", F.col("path").alias("file"), "language", text.alias("text"))
    kind = "array<struct<line: int, method: string, path: string, handler: string, side: string, framework: string>>"
    found = [
        F.when(F.col("language").isin(*rule[0]) & F.col("text").rlike(rule[3]), _matches(F.col("text"), rule)).otherwise(F.array()).cast(kind)
        for rule in PATTERNS
    ]
    rows = own.select("repo", "file", F.inline(F.concat(*found))).where("path <> ''")
    return rows.where((F.col("framework") == "hook") | ~is_junk_path(F.col("path"))).distinct()


def route_evidence(pairs: DataFrame, routes: DataFrame) -> DataFrame:
    """``repo_a, file_a, repo_b, file_b, method, path``: pairs of files of which one serves what the other calls, by method and path.

    Generic paths prove nothing; a method of ``*`` meets any.  Routes are
    joined to the pairs first, so that only routes of paired files meet.
    """
    meaningful = F.size(F.filter(F.split("path", "/"), lambda s: ~s.isin("", "*")))
    own = routes.where(~F.col("path").isin(*GENERIC) & (meaningful >= 2)).select("repo", "file", "method", "path", "side").distinct()

    def side(s: str) -> DataFrame:
        return own.select(F.col("repo").alias(f"repo_{s}"), F.col("file").alias(f"file_{s}"), F.col("method").alias(f"method_{s}"), "path", F.col("side").alias(f"side_{s}"))

    joined = pairs.select("repo_a", "file_a", "repo_b", "file_b").distinct().join(side("a"), ["repo_a", "file_a"]).join(side("b"), ["repo_b", "file_b", "path"])
    equal = (F.col("method_a") == F.col("method_b")) | (F.col("method_a") == "*") | (F.col("method_b") == "*")
    return joined.where((F.col("side_a") != F.col("side_b")) & equal).select(
        "repo_a", "file_a", "repo_b", "file_b", F.when(F.col("method_a") == "*", F.col("method_b")).otherwise(F.col("method_a")).alias("method"), "path"
    ).distinct()


def token_evidence(pairs: DataFrame, tokens: DataFrame, most: int = 5) -> DataFrame:
    """``repo_a, file_a, repo_b, file_b, shared``: the first ``most`` significant tokens (repo, file, tokens) that both files of a pair have."""
    left = tokens.select(F.col("repo").alias("repo_a"), F.col("file").alias("file_a"), F.col("tokens").alias("ta"))
    right = tokens.select(F.col("repo").alias("repo_b"), F.col("file").alias("file_b"), F.col("tokens").alias("tb"))
    joined = pairs.select("repo_a", "file_a", "repo_b", "file_b").distinct().join(left, ["repo_a", "file_a"]).join(right, ["repo_b", "file_b"])
    shared = F.slice(F.array_sort(F.array_intersect("ta", "tb")), 1, most)
    return joined.select("repo_a", "file_a", "repo_b", "file_b", shared.alias("shared")).where(F.size("shared") > 0)


def handler_edges(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """``repo, symbol, symbol_file, relation, method, path``: who handles or fetches each route.

    The named handler (its last part) in the route's file if there is one, else
    the innermost symbol (repo, file, name, start_line, end_line) around the
    route's line; routes with neither give no edge.
    """
    from cartolith.operators.retrieval import innermost_spans

    rows = routes.withColumn("point_id", F.concat_ws("\0", "repo", "file", "line", "method", "path", "side"))
    named = rows.where("handler IS NOT NULL").withColumn("name", F.regexp_extract("handler", r"(\w+)$", 1)).join(
        symbols.select("repo", "file", "name").distinct(), ["repo", "file", "name"]
    ).select("point_id", "name")
    around = innermost_spans(rows.select("point_id", "repo", "file", "line"), symbols).join(named, "point_id", "left_anti")
    relation = F.when(F.col("side") == "server", "HANDLES").otherwise("FETCHES")
    return rows.join(named.unionByName(around.select("point_id", "name")), "point_id").select(
        "repo", F.col("name").alias("symbol"), F.col("file").alias("symbol_file"), relation.alias("relation"), "method", "path"
    ).distinct()
