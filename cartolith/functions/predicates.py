"""Predicates on paths, names and code as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders and suffixes by convention.
IGNORED_FOLDERS = r"(?:^|/)(?:\.git|\.hg|\.svn|node_modules|vendor|dist|build|target|__pycache__|\.venv|\.idea|\.vscode)(?:/|$)"
TEST_FILE = (
    r"(?:_test\.\w+$|(?:^|/)test_[^/]*\.py$|\.(?:test|spec)\.\w+$|Tests?\.(?:java|kt|cs|swift)$|(?:^|/)(?:tests?|__tests__|testdata|spec)/|"
    r"(?:^|/)conftest\.py$)"
)
LOW_PRIORITY = r"(?:[._](?:generated|gen|pb|pb2|min)\.\w+$|\.pb\.\w+$|(?:^|/)(?:mocks?|fixtures|examples?|generated)/)"
ARTIFACT = r"(?:\.(?:o|so|a|dll|exe|class|jar|pyc|wasm|map|lock)$|\.min\.(?:js|css)$|(?:^|/)(?:dist|build|target|out|bin)/)"
FIX_MESSAGE = r"(?i)\b(?:fix|fixes|fixed|hotfix|bug|bugfix|revert|regress|regression)\b"
BINARY = r"(?i)\.(?:png|jpe?g|gif|ico|pdf|zip|gz|tar|woff2?|ttf|eot|mp[34]|mov|bin|so|dylib|dll|exe|class|jar|pyc)$"
HEALTH_ROUTE = r"^/?(?:health|healthz|ready|readyz|live|livez|metrics|ping|status|version)/?$"
ENTRY_POINT = (
    r"^(?:main|init|setUp|tearDown|setup|teardown)$|^(?:[Tt]est|Benchmark|Example|Fuzz)|^__\w+__$|^(?:constructor|New[A-Z]?\w*)$|"
    r"(?:Handler|Middleware|Hook)$|^(?:String|Error|ServeHTTP|MarshalJSON|UnmarshalJSON|Close|Read|Write|Len|Less|Swap)$"
)

#: Languages by file extension.
EXTENSIONS = {
    "go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java",
    "rs": "rust", "rb": "ruby", "cs": "csharp", "php": "php", "kt": "kotlin", "swift": "swift", "c": "c", "h": "c", "cpp": "cpp",
    "svelte": "svelte", "vue": "vue", "astro": "astro",
}


def is_ignored(path: Column) -> Column:
    return path.rlike(IGNORED_FOLDERS)


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def is_low_priority(path: Column) -> Column:
    return path.rlike(LOW_PRIORITY) | is_test_file(path)


def is_artifact(path: Column) -> Column:
    return path.rlike(ARTIFACT)


def is_fix(message: Column) -> Column:
    return message.rlike(FIX_MESSAGE)


def language_of(path: Column) -> Column:
    """Language by extension; null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    pairs = [F.lit(x) for item in EXTENSIONS.items() for x in item]
    return F.element_at(F.create_map(*pairs), extension)


def is_exported(name: Column, language: Column) -> Column:
    """Go: a capital first letter; Python: no leading underscore; others by the letter or not at all private."""
    return (
        F.when(language == "go", name.rlike("^[A-Z]"))
        .when(language == "python", ~F.startswith(name, F.lit("_")))
        .otherwise(~name.rlike("^[_#]"))
    )


def caller_kind(path: Column) -> Column:
    return (
        F.when(path.isNull(), "unresolved")
        .when(path.rlike(r"(?i)bench"), "benchmark")
        .when(is_test_file(path), "test")
        .when(path.rlike(r"(?:^|/)examples?/"), "example")
        .otherwise("production")
    )


def import_category(name: Column, own: Column, standard: list[str]) -> Column:
    """stdlib, internal or external by first segment, ``own`` being the repository's module prefix."""
    first = F.substring_index(name, "/", 1)
    return (
        F.when(first.isin(*standard), "stdlib")
        .when(F.startswith(name, own) | F.startswith(name, F.lit(".")) | F.startswith(name, F.lit("crate::")), "internal")
        .otherwise("external")
    )


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a path glob: ``**`` any folders, ``*`` within one, ``?`` one character."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif glob[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + ("\\" + glob[k] if glob[k] in r"\.+^$()[]{}|" else glob[k]), k + 1
    return f"^{out}$"


def matches_glob(path: Column, glob: str) -> Column:
    """A glob without slash is tried on the file's name alone."""
    return (path if "/" in glob else F.regexp_extract(path, r"([^/]*)$", 1)).rlike(glob_pattern(glob))


def matches_name(name: Column, pattern: str | None) -> Column:
    """Anchored name pattern with ``*``, in any case; none, empty or ``*`` matches all."""
    if not pattern or pattern == "*":
        return F.lit(True)
    return name.rlike("(?i)" + glob_pattern(pattern).replace("[^/]*", ".*"))


def contains_any(text: Column, words: list[str]) -> Column:
    lowered = F.lower(text)
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.instr(lowered, w) > 0)


def is_generic_route(path: Column) -> Column:
    """Health paths, or fewer than two meaningful segments."""
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "*"))
    return path.rlike(HEALTH_ROUTE) | (F.size(segments) < 2)


def is_junk_route(path: Column) -> Column:
    """Query strings, header names, one-letter segments, hexadecimal ids."""
    return path.rlike(r"[?=&]|^[A-Z][a-z]+(?:-[A-Z][a-z]+)+$|(?:^|/)[a-z](?:/|$)|(?:^|/)[0-9a-f]{12,}(?:/|$)")


def is_entry_point(name: Column) -> Column:
    """Names that are called from outside, so that no call is expected: mains, tests, dunders, constructors, handlers."""
    return name.rlike(ENTRY_POINT)


# Verbs that write in a graph query.
WRITE_VERBS = "CREATE DELETE SET MERGE REMOVE DROP DETACH".split()


def is_read_only(query: str) -> bool:
    """Whether a graph query has none of the verbs that write, in any case, as a word."""
    return re.search(r"(?i)\b(?:" + "|".join(WRITE_VERBS) + r")\b", query) is None
