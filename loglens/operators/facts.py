"""Query starts joined to execution statistics: one row per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_ORDER = ("event_time", "event_id")
_START = ("event_time", "event_id", "user_id", "account_id")
_TEXT = ("query_string", "workgroup", "database")
STATS = ("query", "workgroup", "database", "status", "data_scanned", "execution_time_ms")


def query_starts(events: DataFrame) -> DataFrame:
    """One row per execution id: the last start, and the first non-empty text.

    A pair of ordered aggregates combines before the shuffle, so an id with
    very many starts sends one row per task.
    """
    starts = events.filter(
        (F.col("event_name") == "StartQueryExecution")
        & (F.coalesce("query_execution_id", F.lit("")) != "")
    )
    order = F.struct(*_ORDER)
    has_text = F.coalesce("query_string", F.lit("")) != ""
    return (
        starts.groupBy("query_execution_id")
        .agg(
            F.max_by(F.struct(*_START), order).alias("start"),
            F.min_by(F.when(has_text, F.struct(*_TEXT)), F.when(has_text, order)).alias("text"),
        )
        .select("query_execution_id", "start.*", "text.*")
    )


def enrich_queries(starts: DataFrame, stats: DataFrame) -> DataFrame:
    """Starts left-joined to statistics; a statistics row wins as a whole.

    Both sides hold one row per id, so no key is hot, and the aggregate that
    built the starts has already placed them for the join.
    """
    right = stats.select("query_execution_id", F.struct(*STATS).alias("stats"))
    return prefer_stats(starts.join(right, "query_execution_id", "left"))


def prefer_stats(joined: DataFrame, *kept: str) -> DataFrame:
    """Facts of starts with a ``stats`` column, null where none were found; and columns to keep."""
    have = F.col("stats").isNotNull()
    fallback = {
        "query": F.col("query_string"),
        "workgroup": F.col("workgroup"),
        "database": F.col("database"),
        "status": F.lit(""),
        "data_scanned": F.lit(0).cast("bigint"),
        "execution_time_ms": F.lit(0).cast("bigint"),
    }
    return joined.select(
        "query_execution_id",
        *_START,
        *(
            F.when(have, F.col("stats")[c]).otherwise(fallback[c]).alias(c)
            for c in STATS
        ),
        *kept,
    )


def query_facts(enriched: DataFrame) -> DataFrame:
    """Queries that have both a start and a text."""
    return enriched.filter(F.coalesce("query", F.lit("")) != "")


def stats_without_start(stats: DataFrame, starts: DataFrame) -> DataFrame:
    return stats.join(starts.select("query_execution_id"), "query_execution_id", "left_anti")


def polled_data_scanned(events: DataFrame) -> DataFrame:
    """Bytes reported by polls per workgroup, each execution counted once."""
    polls = events.filter(
        (F.col("event_name") == "GetQueryExecution") & (F.col("polled_bytes") > 0)
    )
    once = polls.groupBy(
        F.coalesce("query_execution_id", "event_id").alias("execution")
    ).agg(
        F.max("polled_bytes").alias("polled_bytes"),
        F.max_by("polled_workgroup", F.struct(*_ORDER)).alias("workgroup"),
    )
    return once.groupBy("workgroup").agg(F.sum("polled_bytes").alias("polled_bytes"))
