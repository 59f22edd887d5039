"""SQL text: statement type, tables, fingerprint, masking, tags, complexity, DDL.

All functions take the name of the text column and build one SQL expression, so
a rule table of any length is a single call to the planner. Those that run many
rules also take the name of a column that already holds the upper-case text,
which then is made once per row. Patterns carry
``(?U)`` so that \\w, \\b, \\s and \\d are Unicode classes, and ``(?d)`` so that
only a line feed ends a line.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from .. import rules

# White space in the rules includes the four separator characters 1c to 1f.
_SPACE = r"[\s\x1c-\x1f]"
_NUMBER = r"(?U)\b\d+\.?\d*\b"
# A run up to a quote or an escape, then escapes with their runs. Possessive
# loops keep the matcher flat on literals of any length.
_SINGLE_QUOTED = r"(?d)'[^'\\]*+(?:\\.[^'\\]*+)*+'"
_DOUBLE_QUOTED = r'(?d)"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pattern(rule: str, flags: str = "(?Ud)") -> str:
    """A rule pattern as a SQL literal with the flags and white space it means."""
    return quoted(flags + rule.replace(r"\s", _SPACE))


def _strip(text: str) -> str:
    return f"btrim({text}, {quoted(rules.WHITE_SPACE)})"


def _replace(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(by)})"


def _has(text: str, pattern: str, needles: Iterable[str] = ()) -> str:
    """Pattern test behind plain substring tests; false for a null text."""
    hit = f"rlike({text}, {_pattern(pattern)})"
    gate = " OR ".join(f"contains({text}, {quoted(n)})" for n in needles)
    return f"coalesce(({gate}) AND {hit}, false)" if gate else f"coalesce({hit}, false)"


def _count(text: str, pattern: str, needle: str) -> str:
    found = f"regexp_count({text}, {_pattern(pattern)})"
    return f"CASE WHEN contains({text}, {quoted(needle)}) THEN {found} ELSE 0 END"


def _tags(text: str, upper: str, rule_rows: Iterable[rules.Rule]) -> Column:
    """Array of the tags whose rule matches, in rule order, each once."""
    hits: dict[str, list[str]] = {}
    for rule in rule_rows:
        source = text if rule.raw else upper
        hits.setdefault(rule.tag, []).append(_has(source, rule.pattern, rule.needles))
    cases = (f"CASE WHEN {' OR '.join(t)} THEN {quoted(tag)} END" for tag, t in hits.items())
    return F.expr(f"array_compact(array({', '.join(cases)}))")


def classify_query(query: str) -> Column:
    q = f"upper({_strip(query)})"
    whens = " ".join(
        f"WHEN startswith({q}, {quoted(prefix)}) THEN {quoted(kind)}"
        for prefix, kind in rules.STATEMENT_PREFIXES
    )
    select = f"CASE WHEN contains({q}, ' AS SELECT') THEN 'CTAS' ELSE 'SELECT' END"
    return F.expr(f"CASE WHEN startswith({q}, 'SELECT') THEN {select} {whens} ELSE 'OTHER' END")


def extract_tables(query: str) -> Column:
    """Distinct names after FROM or JOIN, in order of text, keywords left out."""
    found = ", ".join(
        f"regexp_extract_all({query}, {_pattern(rf'\b{word}\s+{rules.TABLE_NAME}', '(?iU)')}, 1)"
        for word in ("FROM", "JOIN")
    )
    words = ", ".join(quoted(w) for w in rules.NOT_TABLES)
    return F.expr(f"filter(array_union({found}), t -> lower(t) NOT IN ({words}))")


def query_fingerprint(query: str) -> Column:
    """Twelve hex digits that equal texts share, whatever their literals."""
    text = f"upper({_strip(query)})"
    text = _replace(text, "'[^']*'", "'?'")
    text = _replace(text, _NUMBER, "?")
    text = _strip(_replace(text, rf"(?U){_SPACE}+", " "))
    return F.expr(f"substring(sha2({text}, 256), 1, 12)")


def masked_query(query: str) -> Column:
    """Struct of ``example``, the text without comments and literals cut at 1000 characters
    for display, and ``digest``, which tells whole masked texts apart."""
    text = _replace(query, r"--[^\n]*", "")
    text = _replace(text, r"(?s)/\*.*?\*/", "")
    text = _replace(text, _SINGLE_QUOTED, "'<VALUE>'")
    text = _replace(text, _DOUBLE_QUOTED, '"<VALUE>"')
    text = _replace(text, _NUMBER, "<NUM>")
    # One row of a one-element array names the masked text for its uses.
    cut = "CASE WHEN length(t) > 1000 THEN concat(substring(t, 1, 1000), '...') ELSE t END"
    both = f"named_struct('example', {cut}, 'digest', sha2(t, 256))"
    return F.expr(f"transform(array({text}), t -> {both})[0]")


def sanitize_query(query: str) -> Column:
    """Text without comments and literals, cut at 1000 characters."""
    return masked_query(query)["example"]


def sql_features(
    query: str, upper: str = "", rule_rows: Iterable[rules.Rule] = rules.FEATURE_RULES
) -> Column:
    return _tags(query, upper or f"upper({query})", rule_rows)


def migration_flags(
    query: str, upper: str = "", rule_rows: Iterable[rules.Rule] = rules.FLAG_RULES
) -> Column:
    return _tags(query, upper or f"upper({query})", rule_rows)


def query_complexity(query: str, upper: str = "") -> Column:
    """Struct of join, CTE, subquery and union counts and grouping tests."""
    u = upper or f"upper({query})"
    joins = ", ".join(
        f"named_struct('kind', {quoted(kind)}, 'n', {_count(u, pattern, 'JOIN')})"
        for kind, pattern in rules.JOIN_RULES
    )
    total = " + ".join(f"({_count(u, pattern, 'JOIN')})" for _, pattern in rules.JOIN_RULES)
    group_by = _has(u, rules.GROUP_BY_PATTERN, ("GROUP",))
    aggregation = _has(u, rules.AGGREGATION_PATTERN, rules.AGGREGATE_NAMES)
    ungrouped = _has(u, rules.UNGROUPED_PATTERN, ("SELECT",))
    return F.expr(
        f"""named_struct(
          'joins', array({joins}),
          'join_count', {total},
          'cte_count', {_count(u, rules.CTE_PATTERN, "WITH")},
          'subquery_count', {_count(u, rules.SUBQUERY_PATTERN, "SELECT")},
          'union_count', {_count(u, rules.UNION_PATTERN, "UNION")},
          'has_group_by', {group_by},
          'has_aggregation', {aggregation},
          'potential_missing_group_by', {aggregation} AND NOT {group_by} AND {ungrouped})"""
    )


def high_complexity(complexity: Column) -> Column:
    least = F.lit(rules.HIGH_COMPLEXITY)
    return (complexity["join_count"] >= least) | (complexity["subquery_count"] >= least)


def is_high_complexity(complexity: str = "complexity") -> Column:
    return high_complexity(F.col(complexity))


def join_types(complexity: str = "complexity") -> Column:
    """Join kinds in counting order, each as often as it occurs."""
    return F.expr(f"flatten(transform({complexity}.joins, j -> array_repeat(j.kind, j.n)))")


def _ddl_type(query: str) -> str:
    q = f"upper({_strip(query)})"
    starts = " OR ".join(f"startswith({q}, '{word}')" for word in rules.DDL_STARTS)
    whens = " ".join(
        f"WHEN rlike({q}, {_pattern(pattern)}) THEN '{kind}'"
        for kind, pattern in rules.DDL_RULES
    )
    return f"CASE WHEN {starts} THEN CASE {whens} END END"


def ddl_type(query: str) -> Column:
    """CREATE, DROP, ALTER, TRUNCATE or REPAIR; null for anything else."""
    return F.expr(_ddl_type(query))


def ddl_operation(query: str, event_time: str) -> Column:
    """Struct of DDL type, object and hour; null for other statements."""
    q = f"upper({_strip(query)})"
    pattern = _pattern(rules.DDL_OBJECT_PATTERN)
    name = f"btrim(regexp_extract({q}, {pattern}, 3), {quoted('`' + chr(34) + chr(39))})"
    kind = _ddl_type(query)
    return F.expr(
        f"""CASE WHEN ({kind}) IS NOT NULL THEN named_struct(
          'type', {kind},
          'object', CASE WHEN rlike({q}, {pattern}) THEN {name} ELSE 'unknown' END,
          'hour', coalesce(hour({event_time}), 0)) END"""
    )


def partition_usage(query: str, upper: str = "") -> Column:
    """Struct: has WHERE, partition-like columns filtered, likely full scan."""
    u = upper or f"upper({query})"
    where = _has(u, rules.WHERE_PATTERN, ("WHERE",))
    filters = ", ".join(
        f"CASE WHEN contains({u}, 'WHERE') AND "
        f"{_has(u, rf'\bWHERE\b.*\b{name.upper()}\s*[=<>]', (name.upper(),))} THEN '{name}' END"
        for name in rules.PARTITION_COLUMNS
    )
    select = _has(u, rules.SELECT_START_PATTERN, ("SELECT",))
    small = _has(u, rules.SMALL_LIMIT_PATTERN, ("LIMIT",))
    return F.expr(
        f"""named_struct(
          'has_where', {where},
          'filters', array_compact(array({filters})),
          'likely_full_scan', {select} AND NOT {where} AND NOT {small})"""
    )
