"""Measures and labels: buckets, error classes, byte sizes, shares, previews."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import rules
from .events import _col
from .sqltext import quoted


def prefer_non_empty(*columns: str) -> Column:
    """First value that is neither null nor empty; else empty."""
    return F.expr(f"coalesce({', '.join(f'''nullif({c}, '')''' for c in columns)}, '')")


def nonzero(*columns: str) -> Column:
    """First number that is neither null nor zero; else zero."""
    return F.expr(f"coalesce({', '.join(f'nullif({c}, 0)' for c in columns)}, 0L)")


def truncate_preview(text: Column | str, length: int, ellipsis: str = "") -> Column:
    """First ``length`` characters, marked with ``ellipsis`` only where cut."""
    text = _col(text)
    head = F.substring(text, 1, length)
    if not ellipsis:
        return head
    return F.when(F.length(text) > length, F.concat(head, F.lit(ellipsis))).otherwise(text)


def error_class(message: str) -> Column:
    low = f"lower(coalesce({message}, ''))"

    def hit(choices) -> str:
        return " OR ".join(
            "(" + " AND ".join(f"contains({low}, {quoted(w)})" for w in words) + ")"
            for words in choices
        )

    whens = " ".join(
        f"WHEN {hit(choices)} THEN {quoted(label)}" for label, choices in rules.ERROR_RULES
    )
    return F.expr(f"CASE {whens} ELSE {quoted(rules.OTHER_ERROR)} END")


def execution_time_bucket(ms: str) -> Column:
    whens = " ".join(
        f"WHEN {ms} < {below} THEN {quoted(label)}" for below, label in rules.TIME_BUCKETS if below
    )
    return F.expr(f"CASE {whens} ELSE {quoted(rules.TIME_BUCKETS[-1][1])} END")


def long_running_class(ms: str) -> Column:
    """Class of a query that ran at least ten minutes; null below."""
    whens = " ".join(
        f"WHEN {ms} >= {minutes * 60_000} THEN '{label}'" for minutes, label in rules.LONG_RUNNING
    )
    return F.expr(f"CASE {whens} END")


def long_running_minutes(ms: str) -> Column:
    """Minutes to one decimal, ties to even, in whole-number arithmetic."""
    tenths = f"({ms} DIV 6000)"
    up = f"{ms} % 6000 > 3000 OR ({ms} % 6000 = 3000 AND {tenths} % 2 = 1)"
    return F.expr(f"({tenths} + CASE WHEN {up} THEN 1 ELSE 0 END) / 10")


def format_bytes(size: str) -> Column:
    """'0 B', else the size over 1024 as often as it goes (to PB), one decimal.

    The quotient is an exact binary fraction, so ties go to the even digit.
    """

    def text(power: int) -> str:
        unit = rules.BYTE_UNITS[power]
        return f"format_string('%.1f {unit}', bround({size} / {1024**power}D, 1))"

    last = len(rules.BYTE_UNITS) - 1
    whens = " ".join(
        f"WHEN {size} < {1024 ** (power + 1)}L THEN {text(power)}" for power in range(last)
    )
    return F.expr(f"CASE WHEN {size} = 0 THEN '0 B' {whens} ELSE {text(last)} END")


def gigabytes(size: str, digits: int) -> Column:
    """Bytes as GB text with ``digits`` decimals, ties to the even digit."""
    return F.expr(f"format_string('%.{digits}f', bround({size} / {1024**3}D, {digits}))")


def share_pct(part: Column, whole: Column) -> Column:
    """Percentage, 0 where the whole is zero or missing."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def feature_note(tag: str) -> Column:
    whens = " ".join(
        f"WHEN {tag} = {quoted(name)} THEN {quoted(note)}"
        for name, note in rules.FEATURE_NOTES.items()
    )
    return F.expr(
        f"CASE WHEN startswith({tag}, 'Trino:') THEN {quoted(rules.DIALECT_NOTE)} {whens} "
        f"ELSE {quoted(rules.DEFAULT_NOTE)} END"
    )
