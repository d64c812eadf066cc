"""Functions paired with their documentation, found by windows over lexed tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lexers.  Order matters: comments and strings first, then structure, then runs of anything else.
_STRING = r"\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`"
_STRUCTURE = r"[{}()\[\];:]|\n[ \t\r]*|[^\n{}()\[\];:\"'`/#]++|[\"'`/#]"
LEX_BRACES = r"//[^\n]*|(?s:/\*.*?\*/)|" + _STRING + "|" + _STRUCTURE
LEX_INDENT = r"(?s:\"\"\".*?\"\"\")|(?s:'''.*?''')|#[^\n]*|" + _STRING + "|" + _STRUCTURE

# The patterns below are tried on trimmed lines.
#: Lines of a comment that direct a tool.
LINT = (
    r"nolint|noqa|eslint|tslint|jshint|jslint|pylint|flake8|mypy|ruff|golint|lint:|nosonar|noinspection|prettier|@ts-|ts-ignore|"
    r"type:\s*ignore|istanbul|c8 |v8 |clippy|rustfmt|checkstyle|spotbugs|spotless|pragma|isort|fmt:|yapf|@?suppress|sonar|go:\w|"
    r"\+build|biome|deno-lint|coverage|cspell|codespell|shellcheck"
)
#: Lines that hold a tag, with what it says of a parameter or result.
TAG = (
    r"[@\\:](?!link)\w[\w-]*|\{@\w+\}|deprecated\b|(?:args|arguments|parameters|params|returns?|raises|throws|yields) ?:$|"
    r"(?:since|author|version) ?:"
)
#: Lines of a licence.
LICENCE = (
    r"\W*copyright\b|\(c\) ?\d{4}|.*all rights reserved|.*spdx-|licen[cs]ed?\b|.*\blicen[cs]e[ds]?\b.*\b(?:apache|mit|bsd|gpl|terms|under)\b|"
    r"redistribution\b|.*this notice must|permission is hereby|.*without warranty|.*warranties or conditions"
)
#: Lines that stand for a description still to be written.
PLACEHOLDER = (
    r"\W*(?:todo|fixme|xxx+|tbd|tba|hack|wip|n/?a|none|null|placeholder|lorem ipsum|pendiente|por hacer|por documentar|"
    r"dokumentation (?:folgt|fehlt)|noch zu|a completer|à compléter|à faire|sans description|keine beschreibung|"
    r"sin (?:descripción|documentar)|no (?:description|docs?|documentation|comment)|"
    r"(?:missing|needs?|write|add)(?: an?| the)? (?:docs?|documentation|description|comment))\b"
)
IGNORED = rf"(?im)^(?:{LINT}|{TAG}|{LICENCE}|{PLACEHOLDER}).*$"
#: Lines of code, commented out.  Prose ends in a full stop, not in one of these forms.
CODE = (
    r"(?m)^(?:.*[;{}]|[})\]].*|.*(?::=|\+=|-=|\*=|[^=<>!\n]==[^=\n]).*|[\w.\[\]]+ ?= .*|.*=> ?\{?|"
    r"(?i:if|for|while|elif|else|def|func|fn|class|switch|match|try|except|catch|with|case)\b.*[:{]|"
    r"(?:return|raise|throw|import|from|let|const|var|package|use|pub|export|await|yield|break|continue|pass)\b(?!.*[a-z]\.$)"
    r"(?: [\w.,\[\]()\"'+*/:-]+){0,6};?|(?:@\w+)?[\w.]+\(.*\) ?[;:]?|(?:</?\w[^>\n]*> ?)+)$"
)
#: A comment within commented-out code.
NESTED = r"(?m)^(?://|#|/\*|--).*$"

# Words that say nothing of what a function does.
FILLER = (
    "a an the this that these those it its is are be was of for to in on at by as and or with from here there see above below "
    "function func method procedure routine helper utility util helpers implementation impl implements implemented description "
    "describe describes documentation documented document docs doc comment comments default simple generic main internal "
    "auto generated autogenerated stub class struct object type value values self used use uses using does do thing things stuff "
    "some something foo bar add put write explain text goes now new code handles handle performs perform executes execute "
    "runs run processes process gets get sets set name named called inheritdoc inherited override overrides overridden wrapper "
    "wraps constructor getter setter returns return result public private static async folgt follows follow later soon"
).split()

#: Words that must be left for a description to say something.
LEAST_WORDS = 2


def is_indented(language: Column, file: Column) -> Column:
    """Whether blocks are delimited by indentation."""
    return (F.lower(language) == "python") | (F.coalesce(language, F.lit("")) == "") & F.lower(file).endswith(".py")


def lexed_tokens(sources: DataFrame) -> DataFrame:
    """Explode ``source_id, text, indented`` into one row per token: ``source_id, indented, pos, tok, kind, head``.

    ``head`` holds the text and all further columns, on the first token only.
    ``sources`` is already distributed by source_id, and exploding keeps that,
    so that the windows that follow sort within partitions only.
    """
    lex = F.when(F.col("indented"), F.regexp_extract_all("text", F.lit(LEX_INDENT), 0)).otherwise(
        F.regexp_extract_all("text", F.lit(LEX_BRACES), 0)
    )
    first, two = F.substring("tok", 1, 1), F.substring("tok", 1, 2)
    indented = F.col("indented")
    kind = (
        F.when(F.substring("tok", 1, 3).isin('"""', "'''") & indented, "doc")
        .when(F.when(indented, first == "#").otherwise(two.isin("//", "/*")), "comment")
        .when(first == "\n", "line")
        .when(first == "{", "open")
        .when(first == "}", "close")
        .when(first.isin("(", "["), "in")
        .when(first.isin(")", "]"), "out")
        .when(first == ":", "colon")
        .when(first == ";", "end")
        .when(F.trim(F.translate("tok", "\t\r\u00a0\u2009\ufeff\u200b", "")) == "", "space")
        .otherwise("word")
    )
    rest = [c for c in sources.columns if c not in ("source_id", "indented", "text")]
    tokens = sources.select("source_id", "indented", "text", *rest, F.posexplode(lex).alias("pos", "tok"))
    head = F.when(F.col("pos") == 0, F.struct("text", *rest)).alias("head")
    return tokens.select("source_id", "indented", "pos", "tok", kind.alias("kind"), head).where(
        (F.col("kind") != "space") | F.col("head").isNotNull()
    )


def delimited_functions(tokens: DataFrame) -> DataFrame:
    """One row per function or method: ``source_id, unit, before, docstring, statements``.

    Cumulative windows give the depth of brackets and braces at each token.  A
    token at depth 0 that follows the end of a block (lag windows) starts a new
    unit; the running count of starts numbers these islands, comments going
    with the code that follows them.  Within a unit the header ends at the
    first brace, colon (where blocks are indented) or semicolon outside
    brackets.  ``before`` is the comment block before the header, ``docstring``
    a string directly after it, ``statements`` the number of words beyond;
    ``head`` is that of the text, in its first unit.
    """
    order = Window.partitionBy("source_id").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def is_(*kinds: str) -> Column:
        return F.col("kind").isin(*kinds)

    depth = tokens.withColumns(
        {
            "brackets": F.sum(F.when(is_("in"), 1).when(is_("out"), -1).otherwise(0)).over(upto),
            "braces": F.sum(F.when(is_("open"), 1).when(is_("close"), -1).otherwise(0)).over(upto),
            "gap": F.lag("tok").over(order),
            "last": F.last(F.when(~is_("line", "comment"), F.col("kind")), ignorenulls=True).over(
                order.rowsBetween(Window.unboundedPreceding, -1)
            ),
        }
    ).where(~is_("line", "space") | F.col("head").isNotNull())
    outside = F.col("brackets") <= 0
    margin = F.col("gap").isNull() | F.col("gap").rlike("^\n\r?$")
    ended = F.when(
        F.col("indented"), margin & (F.lag("indent_body", 1, False).over(order))
    ).otherwise((F.lag("kind").over(order).isin("close", "end")) & (F.lag("braces").over(order) <= 0) & ~is_("end"))
    depth = depth.withColumn("indent_body", F.col("gap").rlike("^\n[ \t]+")).withColumn(
        "unit", F.sum(F.coalesce(ended, F.lit(False)).cast("int")).over(upto)
    )
    within = Window.partitionBy("source_id", "unit").orderBy("pos")
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stop = outside & F.when(F.col("indented"), is_("colon", "end")).otherwise(is_("open", "end") )
    ends = depth.withColumns(
        {
            "starts": F.min(F.when(~is_("comment", "doc", "line", "space"), F.col("pos"))).over(whole),
            "header_end": F.min(F.when(stop, F.col("pos"))).over(whole),
        }
    ).withColumn("previous", F.lag("pos").over(within))
    beyond = F.col("pos") > F.col("header_end")
    return ends.groupBy("source_id", "unit").agg(
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(F.when(is_("comment", "doc") & (F.col("pos") < F.col("starts")), F.struct("pos", "tok")))
                ),
                lambda t: t["tok"],
            ),
            "\n",
        ).alias("before"),
        F.min(F.when(is_("doc") & (F.col("previous") == F.col("header_end")), F.col("tok"))).alias("docstring"),
        F.first("head", ignorenulls=True).alias("head"),
        F.count_if(beyond & is_("word") & F.col("tok").rlike(r"[\p{L}\p{N}]")).alias("statements"),
    )


def telling_text(comment: Column) -> Column:
    """A comment without marks, rules, tags, lint directives, licences, placeholders and commented-out code."""
    bare = F.regexp_replace(comment, r"\*+/|\"\"\"|'''|\r\n?", "\n")
    bare = F.regexp_replace(bare, r"(?m)^[^\S\n]*(?:/\*+!?|///?!?|//+|#+!?|\*+|<!--|--+(?=\s|$))", "")
    bare = F.regexp_replace(bare, r"(?m)^[^\S\n]+|[^\S\n]+$", "")
    told = F.regexp_replace(bare, IGNORED, "")
    return F.when(
        told.rlike(CODE), F.regexp_replace(F.regexp_replace(told, CODE, ""), NESTED, "")
    ).otherwise(told)


def says_something(told: Column, name: Column, signature: Column) -> Column:
    """Whether words beyond those of the name, the signature and filler are left in a telling text."""
    identifiers = F.concat_ws(" ", name, signature)
    parts = F.regexp_extract_all(
        F.regexp_replace(identifiers, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " "), F.lit(r"\p{L}+"), F.lit(0)
    )
    forms = [F.concat(F.array_join(parts, ending + " "), F.lit(ending)) for ending in ("", "s", "es", "d", "ed", "ing")]
    whole = F.array_join(F.regexp_extract_all(identifiers, F.lit(r"\w+"), F.lit(0)), " ")
    known = F.split(F.lower(F.concat_ws(" ", *forms, whole)), " ")
    words = F.regexp_extract_all(
        F.lower(told), F.lit(r"[\p{M}\p{N}_'’]*\p{L}[\p{L}\p{M}\p{N}_'’]*"), F.lit(0)
    )
    left = F.array_except(F.array_except(words, F.array(*map(F.lit, FILLER))), known)
    dense = told.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]{4}")
    return (F.size(left) >= LEAST_WORDS) | dense


def documented_functions(entries: DataFrame) -> DataFrame:
    """Pairs ``entry_id, code, description`` of functions and methods whose description says something.

    The description is ``doc_comment`` or, where that is null, the comment
    block before the signature in ``body`` or the docstring directly after it.
    An entry needs a body with statements beyond its signature.

    Entries are distributed by id once; lexing, windows and grouping keep that
    distribution.  Entries that cannot have a description (no comment mark
    beside the signature and no ``doc_comment``) are not lexed.

    Defined cases: null or empty bodies, empty ``doc_comment``, null ids and
    kinds other than function and method give no pair; null names, signatures
    and languages are empty; rows repeated whole count once; an empty table
    gives no rows; other columns are not read.
    """
    named = entries.where(
        F.col("entry_id").isNotNull() & F.col("kind").isin("function", "method") & (F.length("body") > 0)
    ).select(
        F.col("entry_id").alias("source_id"),
        F.col("body").alias("text"),
        F.coalesce(is_indented(F.col("language"), F.col("file")), F.lit(False)).alias("indented"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("signature", F.lit("")).alias("signature"),
        F.col("doc_comment").alias("comment"),
    )
    told = says_something(telling_text(F.col("comment")), F.col("name"), F.col("signature"))
    mark = F.col("text").rlike(r"^[\s\x{FEFF}\x{200B}]*(?://|/\*|#|\"\"\"|''')|\"\"\"|'''")
    sources = named.where(F.when(F.col("comment").isNull(), mark).otherwise(told)).dropDuplicates(["source_id"])
    functions = delimited_functions(lexed_tokens(sources))
    first = functions.groupBy("source_id").agg(
        F.min_by(F.struct("before", "docstring"), F.when(F.col("statements") > 0, F.col("unit"))).alias("f"),
        F.first("head", ignorenulls=True).alias("head"),
        F.max("statements").alias("statements"),
    )
    first = first.where("statements > 0").select("source_id", "f.*", "head.*")
    description = F.coalesce("comment", F.nullif(F.col("before"), F.lit("")), "docstring")
    pairs = first.withColumn("told", telling_text(description))
    return pairs.where(
        F.col("comment").isNotNull() | says_something(F.col("told"), F.col("name"), F.col("signature"))
    ).select(
        F.col("source_id").alias("entry_id"),
        F.col("text").alias("code"),
        "signature",
        F.regexp_replace(F.regexp_replace("told", r"\n\s*\n", "\n"), r"^\s+|\s+$", "").alias("description"),
    )
