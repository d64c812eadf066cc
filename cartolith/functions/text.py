"""Tokens, trigrams and similarities of text as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a keyword query ignores.
STOP_WORDS = "the and for that with this from are not have function method code file which where when how what".split()


def query_terms(text: str) -> list[str]:
    """Terms of a query, found on the driver: whole words first, then the parts of identifiers, at least three letters, in order."""
    words = [re.sub(r"[^A-Za-z0-9_]", "", w) for w in text.split()]
    parts = [p for w in words if len(w) >= 3 for p in identifier_parts(w)]
    return list(dict.fromkeys(t for t in [w.lower() for w in words] + parts if len(t) >= 3))


def identifier_parts(name: str) -> list[str]:
    """As ``split_identifier``, of one name on the driver."""
    marked = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ", name)
    return [p.lower() for p in re.split(r"[^A-Za-z0-9]+", marked) if len(p) >= 2]


def split_identifier(text: Column) -> Column:
    """Lower-case words of identifiers in ``text``: split at underscores and at changes of case and to digits."""
    t = F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    return F.filter(F.transform(F.split(t, r"[^A-Za-z0-9]+"), F.lower), lambda w: F.length(w) >= 2)


def keywords(text: Column, least: int = 3) -> Column:
    """Distinct lower-case words of at least ``least`` characters that are no stop words, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) >= least)), F.array(*map(F.lit, STOP_WORDS)))


def field_tokens(text: Column, least: int = 3, compact: bool = False) -> Column:
    """All lower-case words and their parts, with repeats; parts of words of one part are not repeated.

    With ``compact`` a text of several words also gives its letters and digits run together.
    """
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+"), F.lit(0))
    whole = F.transform(words, F.lower)
    parts = F.flatten(
        F.transform(words, lambda w: F.filter(split_identifier(w), lambda p: p != F.lower(w)))
    )
    tokens = F.concat(whole, parts)
    if compact:
        tokens = F.concat(tokens, F.when(F.size(words) > 1, F.array(F.array_join(whole, ""))).otherwise(F.array().cast("array<string>")))
    return F.filter(tokens, lambda t: F.length(t) >= least)


def trigrams(text: Column) -> Column:
    """The distinct trigrams of each word, padded by two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))
        ),
    )
    return F.array_distinct(F.flatten(grams))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def name_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(1.0)


def common_prefix_folders(a: Column, b: Column) -> Column:
    """Number of leading folders that two paths share."""
    x, y = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(x), F.size(y))
    differs = F.filter(F.sequence(F.lit(0), n), lambda i: (i >= n) | (F.get(x, i) != F.get(y, i)))
    return F.array_min(differs)


def truncate_lines(text: Column, limit: int = 1500) -> Column:
    """At most ``limit`` characters, cut at the end of a line if there is one."""
    cut = F.substring(text, 1, limit)
    whole = F.regexp_replace(cut, r"\n[^\n]*$", "")
    return F.when(F.length(text) <= limit, text).otherwise(whole)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision; null if either has no length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
