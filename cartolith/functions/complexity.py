"""Complexity, nesting, magic numbers and error handling of function bodies as Column expressions.

Each is a fold over the lines or braces of one body, so that nothing is exploded or shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

INDENT = 4

# Keywords by which decisions are counted, with the blank that follows them.
BRANCHES = r"if |for |while |case |catch |catch\(|except |rescue "
CONTINUATION = r"^(?:else if |elif )|\} (?:else if |elif )"
DECISION = r"^(?:if |for |while |switch |catch |except )| (?:if |for |while |switch |catch |except )"
# Calls that can fail, and signs that an error is dealt with.
FALLIBLE_CALLS = (
    "os.Open", "os.Create", "os.ReadFile", "os.WriteFile", "os.Remove", "os.Mkdir", "os.Stat", "io.Read", "io.Write", "io.Copy",
    "http.Get", "http.Post", "http.Do", "http.NewRequest", "json.Marshal", "json.Unmarshal", "json.NewDecoder", "json.NewEncoder",
    "sql.", "exec.Command", ".Query(", ".QueryRow(", "err :=", "err =",
)
HANDLING_SIGNS = (
    "if err ", "if err!", "!= nil", "err :=", "err =", "return err", "fmt.Errorf", "errors.New", "errors.Is(", "errors.As(", "errors.Join(",
    ".Error()", "except ", "catch (", "catch(", "rescue ", "filepath.Skip",
)
FALLIBLE, HANDLED = ("|".join(re.sub(r"([.()])", r"\\\1", x) for x in words) for words in (FALLIBLE_CALLS, HANDLING_SIGNS))
#: Lines up to which a function that returns an error is taken to hand it on.
SHORT = 12

STRINGS = r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|`[^`]*+`"
QUOTED = STRINGS + r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
C_COMMENTS, HASH_COMMENTS = r"//[^\n]*|/\*(?s:.*?)\*/", r"#[^\n]*"
HASH_LANGUAGES = ("python", "ruby")


def without_comments(body: Column, language: Column) -> Column:
    """The body without comments; comment marks inside strings are left alone."""

    def strip(marks: str) -> Column:
        return F.regexp_replace(body, f"({QUOTED})|{marks}", "$1")

    return F.when(language.isin(*HASH_LANGUAGES), strip(HASH_COMMENTS)).otherwise(strip(C_COMMENTS))


def without_strings(code: Column) -> Column:
    """Strings in double quotes and backticks emptied."""
    return F.regexp_replace(code, STRINGS, '""')


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def cyclomatic(body: Column, language: Column) -> Column:
    """1 plus branches and logical operators; 1 for an empty body."""

    def count(code: Column) -> Column:
        chained = F.regexp_count(code, F.lit("else if |elif "))
        rest = F.regexp_replace(code, "else if |elif ", " ")
        return 1 + chained + F.regexp_count(rest, F.lit(BRANCHES)) + F.regexp_count(rest, F.lit(r"&&|\|\|"))

    return F.coalesce(_let(without_comments(body, language), count), F.lit(1))


def _brace_lines(body: Column, language: Column) -> Column:
    lines = F.transform(F.split(without_comments(body, language), "\n"), lambda x: without_strings(F.trim(F.translate(x, "\t\r", "  "))))
    return F.transform(
        lines,
        lambda x: F.struct(
            F.when(x.rlike(CONTINUATION), 1).when(x.rlike(DECISION), 2).otherwise(0).alias("kind"),
            F.regexp_count(x, F.lit(r"&&|\|\|")).alias("logic"),
            F.regexp_count(x, F.lit(r"\{")).alias("opens"),
            F.regexp_count(x, F.lit(r"\}")).alias("closes"),
        ),
    )


def _indent_lines(body: Column) -> Column:
    """Lines of an indented body that are not blank, without its first ``def`` line; indents from the first line on."""
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(F.translate(x, "\t\r", "  ")) != "")
    starts = F.array_position(F.transform(lines, lambda x: F.trim(F.translate(x, "\t\r", "  ")).rlike("^def ")), True)
    kept = F.when(starts > 0, F.filter(lines, lambda x, i: i != starts - 1)).otherwise(lines)
    measured = F.transform(
        kept,
        lambda x: F.struct(
            F.length(F.regexp_extract(F.regexp_replace(x, "\t", " " * INDENT), "^ *", 0)).alias("indent"),
            F.trim(F.translate(x, "\t\r", "  ")).alias("text"),
        ),
    )
    return _let(
        measured,
        lambda m: F.transform(
            m, lambda x: F.struct(F.greatest(F.lit(0), F.floor((x["indent"] - m[0]["indent"]) / INDENT)).cast("int").alias("depth"), x["text"].alias("text"))
        ),
    )


def cognitive(body: Column, language: Column) -> Column:
    """Decisions weighted by how deep they are nested, continuations and logical operators each 1; 0 for an empty body.

    The function's own brace or ``def`` line is no nesting.
    """
    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("nesting"), F.lit(False).alias("inside"))

    def step(acc: Column, x: Column) -> Column:
        gain = F.when(x["kind"] == 1, 1).when(x["kind"] == 2, 1 + acc["nesting"]).otherwise(0) + x["logic"]
        own = F.when(~acc["inside"] & (x["opens"] > 0), 1).otherwise(0)
        return F.struct(
            (acc["score"] + gain).alias("score"),
            F.greatest(F.lit(0), acc["nesting"] + x["opens"] - own - x["closes"]).alias("nesting"),
            (acc["inside"] | (x["opens"] > 0)).alias("inside"),
        )

    braces = F.aggregate(_brace_lines(body, language), start, step, lambda acc: acc["score"])

    def line(x: Column) -> Column:
        text = x["text"]
        gain = F.when(text.rlike(CONTINUATION), 1).when(text.rlike(DECISION), 1 + x["depth"]).otherwise(0)
        return gain + F.regexp_count(without_strings(text), F.lit(r" and | or "))

    indents = F.aggregate(F.transform(_indent_lines(body), line), F.lit(0), lambda s, v: s + v)
    return F.coalesce(F.when(language == "python", indents).otherwise(braces), F.lit(0))


def nesting(body: Column, language: Column) -> Column:
    """Greatest depth of braces (of indents in Python), the function's own not counted; 0 for an empty body."""
    marks = F.regexp_replace(without_strings(without_comments(body, language)), r"[^{}]+", "")
    rest = F.regexp_replace(marks, r"^(\}*)\{", "$1")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        depth = F.greatest(F.lit(0), acc["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0))
        return F.struct(depth.alias("depth"), F.greatest(acc["most"], depth).alias("most"))

    braces = F.aggregate(F.split(rest, ""), start, step, lambda acc: acc["most"])
    indents = F.array_max(F.transform(_indent_lines(body), lambda x: x["depth"]))
    return F.coalesce(F.when(language == "python", indents).otherwise(braces), F.lit(0))


#: Replacements that leave only the numbers a reader would ask about: index of one digit, other notations, names.
NUMBER_STEPS = (
    (r"\[\d\]", "[]"),
    (r"\b0[xXoObB][0-9a-fA-F_]+", "77"),
    (r"\b\d+(?:\.\d+)?[eE][+-]?\d+", "77"),
    (r"[A-Za-z_$][A-Za-z0-9_$]*", "x"),
)
NUMBER = r"(?:^|[^0-9A-Za-z_])-\d+(?:\.\d+)?|\d+(?:\.\d+)?"
PLAIN_NUMBER = r"^(?:[012]|-1)(?:\.0*)?$"


def magic_numbers(body: Column, language: Column) -> Column:
    """Numbers other than 0, 1, 2 and -1 (also as 1.0), outside strings, comments, constants and one-digit indices."""
    marked = F.regexp_replace(body, r"(?m)^.*nolint:mnd.*$", "")
    lines = F.transform(F.split(without_comments(marked, language), "\n"), lambda x: F.trim(F.translate(x, "\t\r", "  ")))

    def count(line: Column) -> Column:
        x = without_strings(line)
        for pattern, by in NUMBER_STEPS:
            x = F.regexp_replace(x, pattern, by)
        numbers = F.transform(F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0)), lambda m: F.regexp_extract(m, r"-?\d+(?:\.\d+)?$", 0))
        return F.size(F.filter(numbers, lambda m: ~m.rlike(PLAIN_NUMBER)))

    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside"))
    items = F.transform(lines, lambda x: F.struct(x.alias("text"), count(x).alias("n")))

    def step(acc: Column, x: Column) -> Column:
        opens = x["text"].rlike(r"^const ?\($")
        skipped = acc["inside"] | x["text"].rlike(r"^const(?: |\(|$)")
        return F.struct(
            (acc["n"] + F.when(skipped, 0).otherwise(x["n"])).alias("n"),
            F.when(acc["inside"], x["text"] != ")").otherwise(opens).alias("inside"),
        )

    return F.coalesce(F.aggregate(items, start, step, lambda acc: acc["n"]), F.lit(0))


def parameters(signature: Column) -> Column:
    """Parameters of a signature, receivers and self or cls not counted; brackets hold commas together."""
    plain = F.regexp_replace(signature, r"^\s*func\s*\([^)]*\)\s*", "func ")
    inner = F.regexp_extract(plain, r"\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", 1)
    for bracket in (r"\([^()]*\)", r"\([^()]*\)", r"\[[^\[\]]*\]", r"\[[^\[\]]*\]", r"<[^<>]*>", r"<[^<>]*>", r"\{[^{}]*\}"):
        inner = F.regexp_replace(inner, bracket, "")
    parts = F.filter(F.transform(F.split(inner, ","), F.trim), lambda p: ~p.isin("", "self", "cls"))
    return F.when(F.instr(signature, "(") > 0, F.size(parts)).otherwise(0)


def returns_error(signature: Column) -> Column:
    """Whether the results of a signature name an error."""
    return F.coalesce(F.regexp_extract(signature, r"\)([^()]*|[^()]*\([^()]*\)[^()]*)$", 1).rlike(r"\berror\b"), F.lit(False))


def needs_error_handling(signature: Column, body: Column) -> Column:
    return returns_error(signature) | F.coalesce(body.rlike(FALLIBLE), F.lit(False))


def handles_errors(signature: Column, body: Column, lines: Column) -> Column:
    """Signs of handling in the body, or a short function that hands the error on."""
    return F.coalesce(body.rlike(HANDLED), F.lit(False)) | (returns_error(signature) & (F.coalesce(lines, F.lit(1)) <= SHORT))
