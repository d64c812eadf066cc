"""Reading level of the English prose in a text, by the median of classic formulas."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.session import cut_lineage

from cartolith.session import cut_lineage

#: Words of running English prose that a text needs to have a level.
LEAST_WORDS = 40
#: Words that a piece of text needs to count as a sentence.
LEAST_SENTENCE = 3
#: Highest grades of the bands ``basic`` and ``middle``.
BASIC, MIDDLE = 6.5, 12.5

_FENCE = r"(?s)(?:```|~~~).*?(?:```|~~~|\z)"
# Whole lines that are no prose: tables, code by its end or operators; headings; headings by the next line; emphasis,
# traces, code by its beginning, comments, differences; logs; settings.  What a pattern looks for anywhere in a line is
# looked for at once, and what begins a line is only tried there, so that a line of prose is gone through few times.
_LINES = (
    r"[^\n]*(?:\|[^\n]*\|[^\n]*|[;{}\[][^\S\n]*|(?:[:+*!=-]=|[=-]>|&&|\|\|)[^\n]*)",
    r"#{1,6}[^\S\n][^\n]*",
    r"[^\n]++\n[=~-]{3,}",
    r"[^\S\n]*+(?:(?:\*\*|__)[^\n]*(?:\*\*|__)[^\S\n]*"
    r"|(?:at|File) [^\n]*[:(][^\n]*\d+\)?[^\n]*"
    r"|[})\]][^\n]*"
    r"|[\w.\[\]]+ = [^\n]*"
    r"|(?:if|for|while|elif|else|def|func|fn|class|switch|try|except|catch|with)\b[^\n]*[:{][^\S\n]*"
    r"|(?:return|raise|throw|import|from|let|const|var|package|use|pub|export|await|break|continue|pass)\b"
    r"(?![^\n]*[a-z][.!?]$)(?: [^\s]+){0,6}[^\S\n]*(?=\n|\z)"
    r"|[\w.]+\([^\n]*\)[^\S\n]*"
    r"|(?://|/\*|\*/|\$ |>>> |@@)[^\n]*"
    r"|(?:diff|index|---|\+\+\+) [^\n]*)",
    r"[^\n]{0,3}\d{4}-\d\d-\d\d[T ][^\n]*",
    r"\[?(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b[^\n]*",
    r"\d\d:\d\d:\d\d[^\n]*",
    r"[+-]?[^\S\n]*[\w.\[\]\"']+[^\S\n]*[=:][^\S\n]*[\w.\[\]\"'-]*,?[^\S\n]*",
)
_NO_PROSE = r"(?m)^(?:" + "|".join(_LINES) + r")$"
_SENTENCE_END = r"(?<=[.!?])[\"')\]]*\s+|\n\s*\n|\n(?=[A-HJ-Z][a-z' ]|I[a-z'])"

# Frequent words of English, and of neighbouring languages where English does not have them.
ENGLISH = (
    "the of and to is are it that this with for we you not be have can will from by at they was were which when then than "
    "its but our their there what who if or so do does did has had i my your he she his her each every all any now in as on "
    "don't can't that's it's let's they've you'll we've isn't"
).split()
OTHERS = (
    "der die das und ist nicht ein eine einen mit für auf den dem wird vor es zu sich bei wer noch am im aber oder haben wir nach "
    "von seit bitte ob man ihr sie le la les des une est et pas dans pour qui que du au ne se cela vont nous vous il elle ce sont "
    "el los las un una y del por con lo al sin ya esta están pero het een van dat zijn di che gli per non não um uma os ao mais"
).split()

WORD = r"[\p{L}\p{N}]++(?:['’]\p{L}++)*+"


def prose_of(text: Column) -> Column:
    """The running text without code, logs, tables, links and headings; list items become paragraphs."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, "[\u00a0\u2009\u2007\u202f\t]", " ")
    t = F.replace(F.regexp_replace(t, "[\u200b\ufeff]", ""), F.lit("\u2019"), F.lit("'"))
    t = F.regexp_replace(t, _FENCE, "\n")
    t = F.regexp_replace(t, _NO_PROSE, "")
    t = F.regexp_replace(t, r"`[^`\n]*`", "it")
    t = F.regexp_replace(t, r"\b(?:https?|ftp)://\S*[^\s.,;:!?)]", "")
    t = F.regexp_replace(t, r"(?<!\w)(e\.g|i\.e|etc|vs|cf)\.", "$1")
    return F.regexp_replace(t, r"(?m)^[^\S\n]*(?:[*+>-]+|\d+[.)])[^\S\n]+", "\n\n")


def divided(words: Column) -> Column:
    """Lower-case English in which each syllable has one vowel group, by rules in the manner of hyphenation.

    A mute e goes (at the end of a word, or before s or d there, where the
    letters before it make it mute, but not in the few words that have no other
    vowel), and vowels that stand apart are divided by a hyphen (ia, io, eo,
    ua, not in -tion and the like).
    """
    t = F.regexp_replace(
        F.lower(words),
        r"e(?:\b(?<=(?:[bcdfghjkmnpqrstvwxz]|[aeiouy]l)e)(?<!\b(?:th|h|sh|w|b|m)e)"
        r"|(?=s\b)(?<=(?:[bdfjkmnpqrtvw]|[aeiouy]l)e)"
        r"|(?=d\b)(?<=[^aeioutd\W]e)(?<!\b(?:r|b|l|f|w|sh|sl)e))",
        "",
    )
    return F.regexp_replace(t, r"i(?<![tscgx]i)(?=[ao])|u(?<=[^aeiouqg\W]u)(?=a)|e(?=o)", "$0-")


#: Words of three or more vowel groups in divided text.
LONG_WORD = r"(?<![a-z-])[^aeiouy\W]*+[aeiouy]++(?:[^aeiouy\W]++|-)[aeiouy]++(?:[^aeiouy\W]++|-)[aeiouy]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _median(values: Column) -> Column:
    """Median of a non-empty array; of an even number the mean of the middle two."""

    def middle(at: Column) -> Column:
        n = F.size(at)
        low, high = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
        return (F.element_at(at, low) + F.element_at(at, high)) / 2

    return _let(F.array_sort(values), middle)


def _grades(words: Column, letters: Column, syllables: Column, long_words: Column) -> Column:
    """Estimates of one sentence by five formulas: Kincaid, ARI, Coleman-Liau, Fog, SMOG."""
    return F.array(
        0.39 * words + 11.8 * syllables / words - 15.59,
        4.71 * letters / words + 0.5 * words - 21.43,
        5.88 * letters / words - 29.6 / words - 15.8,
        0.4 * (words + 100 * long_words / words),
        1.043 * F.sqrt(30 * long_words) + 3.1291,
    )


def reading_levels(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, words, sentences, grade, band`` for every document; grade and band are null without enough prose.

    Code, logs, tables, links and headings are cut out and the rest is split
    into sentences.  A sentence is English if it has more frequent words of
    English than of other languages; one without any of them goes with the
    majority of the text, and against a majority a single word is not enough.  Each sentence is graded by the median of five
    formulas, a document by the median of its sentences, so that the bulk of
    them decides.  All of it is done row by row in the JVM, without a shuffle.

    Defined cases: null, empty and blank texts and such with fewer than
    ``LEAST_WORDS`` words of English prose have no band; every input row gives
    one row, repeated ids included; the language column is not used; texts are
    read whole.
    """

    def measured(sentence: Column) -> Column:
        return F.transform(
            F.array(F.struct(divided(sentence).alias("split"), F.regexp_extract_all(F.lower(sentence), F.lit(WORD), F.lit(0)).alias("w"))),
            lambda x: F.struct(
                F.size(x["w"]).alias("words"),
                F.length(F.array_join(x["w"], "")).alias("letters"),
                F.regexp_count(x["split"], F.lit("[aeiouy]+")).alias("vowels"),
                F.regexp_count(x["split"], F.lit(LONG_WORD)).alias("long_words"),
                F.size(F.filter(x["w"], lambda w: w.isin(*ENGLISH))).alias("english"),
                F.size(F.filter(x["w"], lambda w: w.isin(*OTHERS) | (F.length(w) < F.octet_length(w)))).alias("other"),
            ),
        )[0]

    def total(m: Column, field: str) -> Column:
        return F.aggregate(m, F.lit(0), lambda a, x: a + x[field])

    def english(m: Column) -> Column:
        leans = total(m, "english") > total(m, "other")
        return _let(
            leans,
            lambda leans: F.filter(
                m,
                lambda x: ((x["english"] > x["other"]) & (leans | (x["english"] > 1)))
                | ((x["english"] == x["other"]) & (x["english"] == 0) & leans),
            ),
        )

    def grade(x: Column) -> Column:
        syllables = F.greatest(x["words"], x["vowels"])
        return _median(_grades(x["words"].cast("double"), x["letters"], syllables, x["long_words"]))

    def level(m: Column) -> Column:
        words = total(m, "words")
        return F.struct(
            words.alias("words"),
            F.size(m).alias("sentences"),
            F.when(words >= LEAST_WORDS, F.round(_median(F.transform(m, grade)), 2)).alias("grade"),
        )

    pieces = F.transform(F.split(prose_of(F.coalesce(text, F.lit(""))), _SENTENCE_END), measured)
    levels = documents.select(
        F.col(doc_id).alias("doc_id"),
        F.inline(F.array(_let(F.filter(pieces, lambda x: x["words"] >= LEAST_SENTENCE), lambda m: _let(english(m), level)))),
    )
    bands = [(BASIC, "basic"), (MIDDLE, "middle"), (float("inf"), "advanced")]
    band = reduce(lambda c, b: c.when(F.col("grade") < b[0], b[1]), bands[1:], F.when(F.col("grade") < bands[0][0], bands[0][1]))
    return levels.withColumn("band", band)


#: Rated documents below which the median of the formulas is not fitted to ratings.
LEAST_RATED = 20
#: Least and greatest school years that are given.
YEARS = (0.0, 20.0)


def with_school_years(levels: DataFrame, ratings: DataFrame) -> DataFrame:
    """Add ``school_years``: the grade on the scale of human ratings (doc_id, grade), by the least-squares line through all rated documents.

    The formulas order texts, but each has a scale of its own.  The line is one
    row of sums, whatever the number of ratings; null and impossible ratings
    are left out and several of a document averaged.  With fewer than
    ``LEAST_RATED`` rated documents school years are null.  Bands stay those of
    the formulas.
    """
    levels = cut_lineage(levels, "reading-levels")
    rated = ratings.where(F.col("grade").between(0, 30)).groupBy("doc_id").agg(F.avg("grade").alias("rated"))
    line = rated.join(levels.where("grade IS NOT NULL").select("doc_id", "grade"), "doc_id").agg(
        F.count("*").alias("_n"), F.regr_slope("rated", "grade").alias("_slope"), F.regr_intercept("rated", "grade").alias("_base")
    )
    years = F.least(F.greatest(F.col("_base") + F.col("_slope") * F.col("grade"), F.lit(YEARS[0])), F.lit(YEARS[1]))
    found = levels.crossJoin(F.broadcast(line))  # one row
    return found.withColumn("school_years", F.when((F.col("_n") >= LEAST_RATED) & F.col("grade").isNotNull(), F.round(years, 1))).drop("_n", "_slope", "_base")


#: Rated documents below which the median of the formulas is not fitted to ratings.
LEAST_RATED = 20
#: Least and greatest school years that are given.
YEARS = (0.0, 20.0)


def with_school_years(levels: DataFrame, ratings: DataFrame) -> DataFrame:
    """Add ``school_years``: the grade on the scale of human ratings (doc_id, grade), by the least-squares line through all rated documents.

    The formulas order texts, but each has a scale of its own.  The line is one
    row of sums, whatever the number of ratings; null and impossible ratings
    are left out and several of a document averaged.  With fewer than
    ``LEAST_RATED`` rated documents school years are null.  Bands stay those of
    the formulas.
    """
    levels = cut_lineage(levels, "reading-levels")
    rated = ratings.where(F.col("grade").between(0, 30)).groupBy("doc_id").agg(F.avg("grade").alias("rated"))
    line = rated.join(levels.where("grade IS NOT NULL").select("doc_id", "grade"), "doc_id").agg(
        F.count("*").alias("_n"), F.regr_slope("rated", "grade").alias("_slope"), F.regr_intercept("rated", "grade").alias("_base")
    )
    years = F.least(F.greatest(F.col("_base") + F.col("_slope") * F.col("grade"), F.lit(YEARS[0])), F.lit(YEARS[1]))
    found = levels.crossJoin(F.broadcast(line))  # one row
    return found.withColumn("school_years", F.when((F.col("_n") >= LEAST_RATED) & F.col("grade").isNotNull(), F.round(years, 1))).drop("_n", "_slope", "_base")
