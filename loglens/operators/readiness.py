"""Migration readiness: one pass of counters, then rungs, level and advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import functions as fn, rules
from ..functions.sqltext import quoted
from .store import object_size_stats

_TAGS = {"flags", "complexity", "partitions", "ddl"}
_ALL_FLAGS = tuple(rule.tag for rule in rules.FLAG_RULES)
_COMPLEX = (
    f"complexity.join_count >= {rules.HIGH_COMPLEXITY} "
    f"OR complexity.subquery_count >= {rules.HIGH_COMPLEXITY}"
)


def readiness_cells(log: DataFrame) -> DataFrame:
    """(text, n, long-running counters): equal texts folded into one row."""
    long = fn.long_running_class("execution_time_ms").alias("long")
    return (
        log.select("query_string", long)
        .groupBy("query_string")
        .agg(
            F.expr("count(1) AS n"),
            *(F.expr(f"count_if(long = '{label}') AS {label}") for _, label in rules.LONG_RUNNING),
        )
    )


def readiness_counters(log: DataFrame) -> DataFrame:
    """One row with every number the score and the advice need.

    The whole log is read once. A classified log keeps its tags; of another one
    each distinct text is matched once.
    """
    text, upper = "query_string", "query_upper"
    if _TAGS <= set(log.columns):
        long = fn.long_running_class("execution_time_ms")
        cells = log.select(
            text, F.upper(text).alias(upper), "flags", "complexity", "partitions",
            F.col("ddl.type").alias("ddl"), F.lit(1).cast("bigint").alias("n"),
            *((long == label).cast("bigint").alias(label) for _, label in rules.LONG_RUNNING),
        )
    else:
        cells = readiness_cells(log).withColumn(upper, F.upper(text)).withColumns(
            {
                "flags": fn.migration_flags(text, upper),
                "complexity": fn.query_complexity(text, upper),
                "partitions": fn.partition_usage(text, upper),
                "ddl": fn.ddl_type(text),
            }
        )
    counters = {
        "selects": ("contains(query_upper, 'SELECT')", "n"),
        "high_complexity": (_COMPLEX, "n"),
        "with_cte": ("complexity.cte_count > 0", "n"),
        "ddl": ("ddl IS NOT NULL", "n"),
        "drops": ("ddl = 'DROP'", "n"),
        "over_1h": ("true", "over_1h"),
        "over_30m": ("true", "over_30m + over_1h"),
        "over_10m": ("true", "over_10m"),
        "full_scans": ("partitions.likely_full_scan", "n"),
        **{f"flag_{flag}": (f"array_contains(flags, '{flag}')", "n") for flag in _ALL_FLAGS},
    }
    return cells.agg(
        F.expr("coalesce(sum(n), 0L) AS events"),
        *(
            F.expr(
                f"coalesce(sum(CASE WHEN query_string <> '' AND ({hit}) THEN {weight} END), 0L) AS {name}"
            )
            for name, (hit, weight) in counters.items()
        ),
    )


def _words(text: str, value: str) -> str:
    """A reason; percentages to one decimal, ties to the even digit."""
    shown = f"bround({value}, 1)" if "%.1f" in text else value
    return f"format_string({quoted(text)}, {shown})"


def _ladder(steps: Sequence[tuple[str, tuple]]) -> tuple[str, str]:
    """Points and reason of the first (value, rung) whose threshold is exceeded."""
    points = " ".join(f"WHEN {value} > {over} THEN {score}" for value, (over, score, _) in steps)
    reasons = " ".join(
        f"WHEN {value} > {over} THEN {_words(text, value)}" for value, (over, _, text) in steps
    )
    return f"CASE {points} ELSE 0 END", f"CASE {reasons} END"


def _same(value: str, rungs: Sequence[tuple]) -> list[tuple[str, tuple]]:
    return [(value, rung) for rung in rungs]


def _flagged(flags: Sequence[str]) -> str:
    return "(" + " + ".join(f"flag_{flag}" for flag in flags) + ")"


def readiness_score(log: DataFrame) -> DataFrame:
    """Score 0-100, level, reasons and counters; every flagged query counts."""
    row = readiness_counters(log).selectExpr(
        "*",
        "high_complexity / greatest(events, 1L) * 100 AS complex_pct",
        "CASE WHEN selects > 0 THEN full_scans / selects * 100 END AS scan_pct",
        f"{_flagged(rules.RISKY_FLAGS)} AS risky",
    )
    parts = (
        _ladder(_same("complex_pct", rules.COMPLEXITY_RUNGS)),
        _ladder(_same("drops", rules.DROP_RUNGS)),
        _ladder(list(zip(("over_1h", "over_30m", "over_10m"), rules.LONG_RUNGS))),
        _ladder(_same("scan_pct", rules.SCAN_RUNGS)),
        _ladder(_same("risky", rules.FLAG_RUNGS)),
    )
    points = " + ".join(p for p, _ in parts)
    reasons = ", ".join(reason for _, reason in parts)
    levels = " ".join(
        f"WHEN complexity >= {least} THEN '{label}'" for least, label in rules.READINESS_LEVELS
    )
    return row.selectExpr("*", f"{points} AS complexity").selectExpr(
        "100 - complexity AS score",
        "complexity",
        f"CASE {levels} ELSE '{rules.BEST_LEVEL}' END AS level",
        f"array_compact(array({reasons})) AS considerations",
        "high_complexity AS high_complexity_queries",
        "ddl AS ddl_operations",
        "drops AS drop_operations",
        "over_10m + over_30m AS long_running_queries",
        "full_scans AS full_table_scans",
        f"{_flagged(_ALL_FLAGS)} AS compatibility_flags",
    )


def recommendations(log: DataFrame, store_events: DataFrame) -> DataFrame:
    """Advice lines in order, or the one default line."""
    mean = object_size_stats(store_events).select("avg_object_bytes").scalar()
    geo, federated = _flagged(("GEOSPATIAL",)), _flagged(("FEDERATED_QUERY",))
    # Advice: (counter it names or None, condition)
    advice = {
        "complex": ("high_complexity", "high_complexity > 0"),
        "drops": ("drops", f"drops > {rules.ADVICE_DROPS_OVER}"),
        "long": ("over_1h", "over_1h > 0"),
        "scans": ("full_scans", f"full_scans > {rules.ADVICE_SCANS_OVER}"),
        "small": (None, f"mean_bytes < {rules.MEDIUM_OBJECT_BYTES}"),
        "cte": ("with_cte", f"with_cte > {rules.ADVICE_CTES_OVER}"),
        "geo": (geo, f"{geo} > 0"),
        "federated": (federated, f"{federated} > 0"),
    }
    lines = ", ".join(
        f"CASE WHEN {hit} THEN "
        + (_words(rules.ADVICE[name], value) if value else quoted(rules.ADVICE[name]))
        + " END"
        for name, (value, hit) in advice.items()
    )
    row = readiness_counters(log).withColumn("mean_bytes", mean)
    return (
        row.selectExpr(f"array_compact(array({lines})) AS lines")
        .selectExpr(
            f"posexplode(CASE WHEN size(lines) > 0 THEN lines ELSE array({quoted(rules.ADVICE['none'])}) END)"
            " AS (pos, recommendation)"
        )
        .selectExpr("pos + 1 AS rank", "recommendation")
    )
