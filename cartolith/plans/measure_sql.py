"""The measures of function bodies in SQL: folds over lists of lines and braces."""

from __future__ import annotations

from cartolith.functions import complexity

_STRINGS = complexity.STRINGS.replace("*+", "*").replace("'", "''")
_QUOTED = complexity.QUOTED.replace("*+", "*").replace("'", "''")
LANGUAGE = "lower(coalesce(language, ''))"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _plain(text: str) -> str:
    return f"trim(translate({text}, chr(9) || chr(13), '  '))"


def _code(body: str) -> str:
    return (
        f"CASE WHEN {LANGUAGE} IN ('python', 'ruby') THEN regexp_replace({body}, '({_QUOTED})|{complexity.HASH_COMMENTS}', '\\1', 'g')"
        f" ELSE regexp_replace({body}, '({_QUOTED})|{complexity.C_COMMENTS}', '\\1', 'g') END"
    )


def _bare(text: str) -> str:
    return f"regexp_replace({text}, '{_STRINGS}', '\"\"', 'g')"


def _numbers(line: str) -> str:
    text = _bare(line)
    for pattern, by in complexity.NUMBER_STEPS:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return f"len(list_filter(regexp_extract_all({text}, '{complexity.NUMBER}'), lambda m: NOT regexp_matches(regexp_extract(m, '-?\\d+(?:\\.\\d+)?$', 0), '{complexity.PLAIN_NUMBER}')))"


_CYCLOMATIC = (
    f"coalesce(1 + {_count('code', 'else if |elif ')} + {_count("regexp_replace(code, 'else if |elif ', ' ', 'g')", complexity.BRANCHES)}"
    f" + {_count("regexp_replace(code, 'else if |elif ', ' ', 'g')", '&&|\\|\\|')}, 1)"
)
_KIND = f"CASE WHEN regexp_matches({{0}}, '{complexity.CONTINUATION.replace('}', '}}')}') THEN 1 WHEN regexp_matches({{0}}, '{complexity.DECISION}') THEN 2 ELSE 0 END::BIGINT"
_BRACE_ITEMS = (
    f"list_transform(list_transform(string_split(code, chr(10)), lambda x: {_bare(_plain('x'))}), lambda x: {{'s': 0::BIGINT, 'n': 0::BIGINT, 'f': false, 'k': {_KIND.format('x')},"
    f" 'l': {_count('x', '&&|\\|\\|')}::BIGINT, 'o': {_count('x', '\\{')}::BIGINT, 'c': {_count('x', '\\}')}::BIGINT}})"
)
_COGNITIVE_BRACES = (
    f"list_reduce({_BRACE_ITEMS}, lambda a, x: {{'s': a.s + CASE x.k WHEN 1 THEN 1 WHEN 2 THEN 1 + a.n ELSE 0 END + x.l,"
    " 'n': greatest(0, a.n + x.o - CASE WHEN NOT a.f AND x.o > 0 THEN 1 ELSE 0 END - x.c), 'f': a.f OR x.o > 0, 'k': x.k, 'l': x.l, 'o': x.o, 'c': x.c},"
    " {'s': 0::BIGINT, 'n': 0::BIGINT, 'f': false, 'k': 0::BIGINT, 'l': 0::BIGINT, 'o': 0::BIGINT, 'c': 0::BIGINT}).s"
)
_COGNITIVE_INDENTS = (
    f"coalesce(list_sum(list_transform(indents, lambda x: CASE WHEN regexp_matches(x.text, '{complexity.CONTINUATION}') THEN 1"
    f" WHEN regexp_matches(x.text, '{complexity.DECISION}') THEN 1 + x.depth ELSE 0 END + {_count(_bare('x.text'), ' and | or ')})), 0)"
)
_NESTING_BRACES = (
    "list_reduce(list_transform(string_split(rest, ''), lambda x: {'d': 0::BIGINT, 'm': 0::BIGINT, 'b': x}),"
    " lambda a, x: {'d': greatest(0, a.d + CASE x.b WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END), 'm': greatest(a.m, a.d + CASE x.b WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END), 'b': x.b},"
    " {'d': 0::BIGINT, 'm': 0::BIGINT, 'b': ''}).m"
)
_MAGIC = (
    f"coalesce(list_reduce(list_transform(list_transform(string_split(unmarked, chr(10)), lambda x: {_plain('x')}), lambda x: {{'n': {_numbers('x')}::BIGINT, 'i': false, 't': x}}),"
    " lambda a, x: {'n': a.n + CASE WHEN a.i OR regexp_matches(x.t, '^const(?: |\\(|$)') THEN 0 ELSE x.n END,"
    " 'i': CASE WHEN a.i THEN x.t <> ')' ELSE regexp_matches(x.t, '^const ?\\($') END, 't': x.t}, {'n': 0::BIGINT, 'i': false, 't': ''}).n, 0)"
)


def _parameters() -> str:
    inner = r"regexp_extract(regexp_replace(signature, '^\s*func\s*\([^)]*\)\s*', 'func '), '\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)', 1)"
    for bracket in (r"\([^()]*\)", r"\([^()]*\)", r"\[[^\[\]]*\]", r"\[[^\[\]]*\]", "<[^<>]*>", "<[^<>]*>", r"\{[^{}]*\}"):
        inner = f"regexp_replace({inner}, '{bracket}', '', 'g')"
    parts = f"len(list_filter(list_transform(string_split({inner}, ','), lambda p: trim(p)), lambda p: p NOT IN ('', 'self', 'cls')))"
    return f"CASE WHEN coalesce(signature, '') <> '' THEN CASE WHEN instr(signature, '(') > 0 THEN {parts} ELSE 0 END END"


_RETURNS = r"coalesce(regexp_matches(regexp_extract(signature, '\)([^()]*|[^()]*\([^()]*\)[^()]*)$', 1), '\berror\b'), false)"


def measured_sql(test: str) -> str:
    """``measured``: function_measures over ``entries``; ``test`` is the pattern of test files."""
    lines = "coalesce(CASE WHEN end_line >= start_line THEN end_line - start_line + 1 ELSE 1 END, 1)"
    return f"""
bodies AS (SELECT *, {LANGUAGE} AS lang, {_code('body')} AS code, {_code("regexp_replace(body, '(?m)^.*nolint:mnd.*$', '', 'g')")} AS unmarked, {lines} AS lines,
    coalesce(regexp_matches(file, '{test}'), false) AS is_test,
    list_filter(string_split(body, chr(10)), lambda x: {_plain('x')} <> '') AS filled
  FROM entries WHERE kind IN ('function', 'method')),
shaped AS (SELECT *, regexp_replace(regexp_replace({_bare('code')}, '[^{{}}]+', '', 'g'), '^(\\}}*)\\{{', '\\1') AS rest,
    list_transform(list_filter(filled, lambda x, i: i <> coalesce(list_position(list_transform(filled, lambda y: starts_with({_plain('y')}, 'def ')), true), 0)),
      lambda x: {{'indent': length(regexp_extract(replace(x, chr(9), '    '), '^ *', 0)), 'text': {_plain('x')}}}) AS kept FROM bodies),
indented AS (SELECT *, list_transform(kept, lambda x: {{'depth': greatest(0, floor((x.indent - kept[1].indent) / {complexity.INDENT}))::BIGINT, 'text': x.text}}) AS indents FROM shaped),
measured AS (SELECT repo_key, file, name, start_line, lines, {_CYCLOMATIC} AS cyclomatic,
    coalesce(CASE WHEN lang = 'python' THEN {_COGNITIVE_INDENTS} ELSE {_COGNITIVE_BRACES} END, 0)::BIGINT AS cognitive,
    coalesce(CASE WHEN lang = 'python' THEN list_max(list_transform(indents, lambda x: x.depth)) ELSE {_NESTING_BRACES} END, 0)::BIGINT AS nesting,
    CASE WHEN NOT is_test THEN {_MAGIC} END AS magic, {_parameters()} AS parameters,
    CASE WHEN NOT is_test AND ({_RETURNS} OR coalesce(regexp_matches(body, '{complexity.FALLIBLE}'), false))
         THEN (coalesce(regexp_matches(body, '{complexity.HANDLED}'), false) OR ({_RETURNS} AND lines <= {complexity.SHORT}))::INT END AS handled
  FROM indented)"""
