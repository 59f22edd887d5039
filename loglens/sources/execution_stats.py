"""Execution statistics, one row per execution id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import rules

_FIELDS = ("query", "workgroup", "database", "status", "data_scanned", "execution_time_ms")


def flatten_executions(executions: DataFrame) -> DataFrame:
    """Nested execution records to flat columns."""
    return executions.select(
        F.col("QueryExecutionId").alias("query_execution_id"),
        F.col("Query").alias("query"),
        F.col("WorkGroup").alias("workgroup"),
        F.col("QueryExecutionContext.Database").alias("database"),
        F.col("Status.State").alias("status"),
        F.col("Statistics.DataScannedInBytes").alias("data_scanned"),
        F.col("Statistics.EngineExecutionTimeInMillis").alias("execution_time_ms"),
    )


def read_execution_stats(rows: DataFrame) -> DataFrame:
    """Defaults filled in, rows without id or text dropped, one row per id.

    Of several snapshots of one execution the one that ran longest is kept.
    """
    kept = rows.filter(
        (F.coalesce("query_execution_id", F.lit("")) != "")
        & (F.coalesce("query", F.lit("")) != "")
    ).withColumns(
        {
            "workgroup": F.coalesce("workgroup", F.lit(rules.DEFAULT_WORKGROUP)),
            "database": F.coalesce("database", F.lit(rules.DEFAULT_DATABASE)),
            "status": F.coalesce("status", F.lit("")),
            "data_scanned": F.coalesce("data_scanned", F.lit(0)).cast("bigint"),
            "execution_time_ms": F.coalesce("execution_time_ms", F.lit(0)).cast("bigint"),
        }
    )
    latest = F.struct("execution_time_ms", "data_scanned", "status", "query", "workgroup", "database")
    best = kept.groupBy("query_execution_id").agg(F.max(latest).alias("row"))
    return best.select("query_execution_id", *(F.col("row")[c].alias(c) for c in _FIELDS))
