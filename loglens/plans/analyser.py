"""The query log to all report tables, from one classified copy."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import querylog as ql, ranking as rk, readiness as rd, store as so

# Everything the report tables read; the upper-case text and the statement
# text's other helpers are not stored.
_STORED = (
    "event_id", "event_time", "user_id", "workgroup", "status", "error_message",
    "execution_time_ms", "query_id", "query_string", "data_scanned",
    "query_type", "features", "flags", "complexity", "partitions", "ddl",
)


def store_classified(log: DataFrame, path: str) -> DataFrame:
    """Match every rule once per query and keep the tags as Parquet columns.

    The tables below each read a few narrow columns of it, and only the ones
    that show text read the text. No row is shuffled.
    """
    tagged = ql.classify_log(log)
    tagged.select(*(c for c in _STORED if c in tagged.columns)).write.mode("overwrite").parquet(path)
    return log.sparkSession.read.parquet(path)


def report_tables(classified: DataFrame, store_events: DataFrame) -> dict[str, DataFrame]:
    """All tables of the analysis report over a classified log, lazy."""
    log = classified
    days = ql.daily_counts(log)
    return {
        "analysis_period": ql.analysis_period(log, store_events),
        "avg_queries_per_day": ql.avg_queries_per_day(log, log, store_events),
        "s3_totals": so.s3_totals(store_events),
        "top_buckets": so.top_buckets(store_events),
        "s3_bucket_bytes": so.s3_bucket_bytes(store_events),
        "object_size_stats": so.object_size_stats(store_events),
        "last_days": rk.last_n_days(days, 14),
        "hourly_counts": ql.hourly_counts(log),
        "peak_concurrency": ql.peak_concurrency(log),
        "feature_notes": ql.feature_notes(classified),
        "sql_feature_examples": ql.sql_feature_examples(classified),
        "status_counts": ql.status_counts(log),
        "failure_rate": ql.failure_rate(log),
        "errors_ranked": ql.errors_ranked(log),
        "error_examples": ql.error_examples(log),
        "execution_time_histogram": ql.execution_time_histogram(log),
        "execution_time_stats": ql.execution_time_stats(log),
        "join_types_ranked": ql.join_types_ranked(classified),
        "complexity_totals": ql.complexity_totals(classified),
        "first_high_complexity": ql.first_high_complexity(classified),
        "ddl_by_type": ql.ddl_by_type(classified),
        "ddl_by_hour": ql.ddl_by_hour(classified),
        "ddl_by_table": ql.ddl_by_table(classified),
        "ddl_samples_by_type": ql.ddl_samples_by_type(classified),
        "top_ddl_users": ql.top_ddl_users(classified),
        "partition_column_counts": ql.partition_column_counts(classified),
        "partition_filter_totals": ql.partition_filter_totals(classified),
        "long_running_totals": ql.long_running_totals(log),
        "longest_queries": ql.longest_queries(log),
        "data_scanned_stats": ql.data_scanned_stats(log),
        "top_scanners": ql.top_scanners(log),
        "data_scanned_by_workgroup": ql.data_scanned_by_workgroup(log),
        "flags_ranked": ql.flags_ranked(classified),
        "migration_flag_examples": ql.migration_flag_examples(classified),
        "readiness_score": rd.readiness_score(log),
        "recommendations": rd.recommendations(log, store_events),
    }
