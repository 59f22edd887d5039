"""Scalar functions: pure column expressions over built-in functions."""

from .events import (
    day_key,
    hour_key,
    minute_key,
    object_prefix,
    parse_event_time,
    s3_operation,
    user_id,
)
from .measures import (
    error_class,
    execution_time_bucket,
    feature_note,
    format_bytes,
    gigabytes,
    long_running_class,
    long_running_minutes,
    nonzero,
    prefer_non_empty,
    share_pct,
    truncate_preview,
)
from .sqltext import (
    classify_query,
    ddl_type,
    ddl_operation,
    extract_tables,
    masked_query,
    migration_flags,
    partition_usage,
    query_complexity,
    query_fingerprint,
    sanitize_query,
    sql_features,
)

__all__ = [name for name in dir() if not name.startswith("_")]
