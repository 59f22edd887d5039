"""The query log: one row per logged query, classified, and its aggregates.

``query_log`` gives the columns one spelling; ``classify_log`` adds the tags
lazily, so a plan computes only those it reads. Every count takes an optional
weight column ``n``: ``text_cells`` folds equal texts into one row with their
number, after which each text is matched once however often it was run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import functions as fn, rules
from ..functions.sqltext import high_complexity, is_high_complexity, join_types
from .ranking import ARRIVAL, count_and_first, first_k, first_k_and_count, top_k, with_share

_ALIASES = {
    "query_string": ("query_string", "query"),
    "query_id": ("query_execution_id", "query_id"),
    "workgroup": ("workgroup", "work_group"),
    "error_message": ("error_message", "state_change_reason"),
}
_BYTES = ("data_scanned_bytes", "data_scanned_in_bytes")


def prefer_fields(rows: DataFrame) -> DataFrame:
    """Gives each doubly spelled field one column, the first non-empty value."""

    def have(names: Sequence[str]) -> list[str]:
        return [n for n in names if n in rows.columns]

    merged = {
        name: fn.prefer_non_empty(*have(names)) for name, names in _ALIASES.items() if have(names)
    }
    if have(_BYTES):
        merged["data_scanned"] = fn.nonzero(*have(_BYTES))
    gone = {n for names in _ALIASES.values() for n in names} | set(_BYTES)
    kept = [c for c in rows.columns if c not in gone]
    return rows.select(*kept, *(column.alias(name) for name, column in merged.items()))


def query_log(rows: DataFrame) -> DataFrame:
    """Log rows ready for classification: merged fields, user, parsed time."""
    log = prefer_fields(rows)
    if "user_id" not in log.columns:
        log = log.withColumn("user_id", fn.user_id("user_arn", F.lit("")))
    fixes = {
        "user_id": F.coalesce("user_id", F.lit(rules.UNKNOWN_USER)),
        "status": F.upper(F.coalesce("status", F.lit(""))),
    }
    if log.schema["event_time"].dataType.simpleString() == "string":
        fixes["event_time"] = fn.parse_event_time("event_time")
    return log.withColumns(fixes)


def classify_log(log: DataFrame) -> DataFrame:
    """Adds all tag columns; those nobody reads are pruned from the plan."""
    text, upper = "query_string", "query_upper"
    tags = {
        "query_type": fn.classify_query(text),
        "features": fn.sql_features(text, upper),
        "flags": fn.migration_flags(text, upper),
        "complexity": fn.query_complexity(text, upper),
        "partitions": fn.partition_usage(text, upper),
    }
    if "event_time" in log.columns:
        tags["ddl"] = fn.ddl_operation(text, "event_time")
    return log.withColumn(upper, F.upper(text)).withColumns(tags)


def text_cells(log: DataFrame, *keys: str) -> DataFrame:
    """(text, keys, n): equal texts folded into one row with their number."""
    return log.groupBy("query_string", *keys).agg(F.count(F.lit(1)).alias("n"))


def _weight(df: DataFrame) -> Column:
    return F.col("n") if "n" in df.columns else F.lit(1).cast("bigint")


def _tag_rows(classified: DataFrame, tags: str, name: str, *columns: str | Column) -> DataFrame:
    """One row per tag. The outer form keeps the planner from testing the array
    for emptiness first, which would match every rule twice."""
    rows = classified.select(F.explode_outer(tags).alias(name), *columns)
    return rows.filter(F.col(name).isNotNull())


def _tag_counts(classified: DataFrame, tags: str, name: str) -> DataFrame:
    rows = _tag_rows(classified, tags, name, _weight(classified).alias("n"))
    return rows.groupBy(name).agg(F.sum("n").alias("query_count"))


def _with_tag(classified: DataFrame, tag: str, hit: Callable[[Column], Column]) -> DataFrame:
    """Rows whose tag fulfils ``hit``. A generator names the tag, so it is computed once: a
    plain filter sinks to the scan and its patterns are tested there and in each use."""
    found = F.explode_outer(F.filter(F.array(tag), hit)).alias(tag)
    rows = classified.select(*(c for c in classified.columns if c != tag), found)
    return rows.filter(F.col(tag).isNotNull())


def _with_ddl(classified: DataFrame) -> DataFrame:
    return _with_tag(classified, "ddl", lambda d: d.isNotNull())


def _count_where(hit: Column, weight: Column) -> Column:
    return F.coalesce(F.sum(F.when(hit, weight)), F.lit(0).cast("bigint"))


# --- language features ---


def sql_feature_counts(classified: DataFrame) -> DataFrame:
    return _tag_counts(classified, "features", "feature")


def sql_feature_examples(classified: DataFrame, k: int = 2) -> DataFrame:
    example = fn.truncate_preview("query_string", 300, "...").alias("example")
    rows = _tag_rows(classified, "features", "feature", *ARRIVAL, example)
    return first_k(rows, ["feature"], ARRIVAL, k).select("feature", "rank", "example")


def top_features(classified: DataFrame, k: int = 20) -> DataFrame:
    return top_k(sql_feature_counts(classified), "query_count", ["feature"], k)


def feature_notes(classified: DataFrame, k: int = 15) -> DataFrame:
    return top_features(classified, k).withColumn("note", fn.feature_note("feature"))


# --- complexity ---


def join_type_counts(classified: DataFrame) -> DataFrame:
    """Joins per kind over all queries; kinds that never occur are left out."""
    rows = classified.select(
        F.explode("complexity.joins").alias("j"), _weight(classified).alias("n")
    )
    counts = rows.groupBy(F.col("j.kind").alias("join_type")).agg(
        F.sum(F.col("j.n") * F.col("n")).alias("join_count")
    )
    return counts.filter("join_count > 0")


def join_types_ranked(classified: DataFrame) -> DataFrame:
    return join_type_counts(classified).orderBy(F.desc("join_count"), "join_type")


def complexity_totals(classified: DataFrame) -> DataFrame:
    c, n = F.col("complexity"), _weight(classified)
    return classified.agg(
        _count_where(is_high_complexity(), n).alias("high_complexity"),
        _count_where(c["join_count"] >= rules.MULTIPLE_JOINS, n).alias("multiple_joins"),
        _count_where(c["cte_count"] > 0, n).alias("with_cte"),
    )


def high_complexity_queries(classified: DataFrame) -> DataFrame:
    c = F.col("complexity")
    high = _with_tag(classified, "complexity", high_complexity)
    return high.select(
        *ARRIVAL,
        "query_id",
        c["join_count"].alias("join_count"),
        join_types().alias("join_types"),
        c["cte_count"].alias("cte_count"),
        c["subquery_count"].alias("subquery_count"),
        fn.truncate_preview("query_string", 500).alias("query_preview"),
    )


def first_high_complexity(classified: DataFrame, k: int = 10) -> DataFrame:
    """First k in order of arrival and the number of the others."""
    rows = high_complexity_queries(classified).withColumn("of", F.lit("all"))
    return first_k_and_count(rows, "of", ARRIVAL, k).orderBy("rank").select(
        "query_id",
        "join_count",
        F.coalesce(
            F.nullif(F.array_join("join_types", ", "), F.lit("")), F.lit("N/A")
        ).alias("join_types"),
        "cte_count",
        "subquery_count",
        "query_preview",
        F.greatest(F.col("total") - k, F.lit(0)).alias("more_queries"),
    )


# --- DDL ---


def ddl_operations(classified: DataFrame) -> DataFrame:
    return _with_ddl(classified).select(
        *ARRIVAL, "user_id", "ddl.*", "query_string"
    )


def _ddl_counts(classified: DataFrame, **keys: str) -> DataFrame:
    rows = _with_ddl(classified)
    return rows.groupBy(*(F.col(c).alias(name) for name, c in keys.items())).agg(
        F.count(F.lit(1)).alias("ddl_count")
    )


def ddl_by_type(classified: DataFrame) -> DataFrame:
    return _ddl_counts(classified, ddl_type="ddl.type")


def ddl_by_hour(classified: DataFrame) -> DataFrame:
    return _ddl_counts(classified, hour="ddl.hour")


def ddl_by_user(classified: DataFrame) -> DataFrame:
    return _ddl_counts(classified, user_id="user_id", ddl_type="ddl.type")


def ddl_by_table(classified: DataFrame) -> DataFrame:
    return _ddl_counts(classified, table_name="ddl.object")


def ddl_samples_by_type(classified: DataFrame, k: int = 10) -> DataFrame:
    """First k per type and the number of the others."""
    ops = ddl_operations(classified).filter(F.col("type").isin(*rules.DDL_SAMPLE_TYPES))
    rows = ops.select("type", *ARRIVAL, "user_id", "query_string")
    return first_k_and_count(rows, "type", ARRIVAL, k).select(
        F.col("type").alias("ddl_type"),
        "rank",
        "user_id",
        "query_string",
        F.greatest(F.col("total") - k, F.lit(0)).alias("more_queries"),
    )


def top_ddl_users(classified: DataFrame, k: int = 10) -> DataFrame:
    """Users by DDL total with a column per main type."""
    kinds = ("CREATE", "DROP", "ALTER")
    wide = ddl_by_user(classified).groupBy("user_id").agg(
        *(
            _count_where(F.col("ddl_type") == kind, F.col("ddl_count")).alias(f"{kind.lower()}_count")
            for kind in kinds
        ),
        F.sum("ddl_count").alias("total_count"),
    )
    return top_k(wide, "total_count", ["user_id"], k)


# --- partition use ---


def partition_column_counts(classified: DataFrame) -> DataFrame:
    return _tag_counts(classified, "partitions.filters", "column_name")


def partition_filter_totals(classified: DataFrame) -> DataFrame:
    p, n = F.col("partitions"), _weight(classified)
    filtered = F.size(p["filters"]) > 0
    return classified.agg(
        _count_where(filtered, n).alias("using_filter"),
        _count_where(p["has_where"] & ~filtered, n).alias("missing_filter"),
        _count_where(p["likely_full_scan"], n).alias("full_scans"),
    )


# --- migration flags ---


def migration_flag_counts(classified: DataFrame) -> DataFrame:
    """All queries per flag."""
    return _tag_counts(classified, "flags", "flag")


def migration_flag_examples(classified: DataFrame, k: int = rules.FLAG_EXAMPLES) -> DataFrame:
    preview = fn.truncate_preview("query_string", 300).alias("query_preview")
    rows = _tag_rows(classified, "flags", "flag", *ARRIVAL, "query_id", "user_id", preview)
    return first_k(rows, ["flag"], ARRIVAL, k).select("flag", "rank", "query_id", "user_id", "query_preview")


def flags_ranked(classified: DataFrame) -> DataFrame:
    """Flags by the number of queries, with the first example; one pass over the log."""
    preview = fn.truncate_preview("query_string", 300).alias("query_preview")
    rows = _tag_rows(classified, "flags", "flag", *ARRIVAL, preview)
    return count_and_first(rows, "flag", "query_count", "query_preview").orderBy(F.desc("query_count"), "flag")


# --- status and errors ---


def status_counts(log: DataFrame) -> DataFrame:
    counts = log.filter("status <> ''").groupBy("status").agg(
        F.count(F.lit(1)).alias("query_count")
    )
    return with_share(counts, "query_count")


def failure_rate(log: DataFrame) -> DataFrame:
    out = log.filter("status <> ''").agg(
        F.count_if(F.col("status") == "SUCCEEDED").alias("succeeded"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )
    return out.withColumn("failure_rate", fn.share_pct(F.col("failed"), F.col("total")))


def _failures(log: DataFrame) -> DataFrame:
    return log.filter("status = 'FAILED'").withColumn(
        "error_type", fn.error_class("error_message")
    )


def error_type_counts(log: DataFrame) -> DataFrame:
    return _failures(log).groupBy("error_type").agg(F.count(F.lit(1)).alias("error_count"))


def error_examples(log: DataFrame, k: int = 3) -> DataFrame:
    rows = _failures(log).filter("error_message <> ''").select(
        "error_type", *ARRIVAL, fn.truncate_preview("error_message", 200).alias("example")
    )
    return first_k(rows, ["error_type"], ARRIVAL, k).select("error_type", "rank", "example")


def errors_ranked(log: DataFrame) -> DataFrame:
    """Error classes by number, with the first message; one pass over the log."""
    message = F.nullif(F.col("error_message"), F.lit(""))
    preview = fn.truncate_preview(fn.truncate_preview(message, 200), 100, "...").alias("example")
    rows = _failures(log).select("error_type", *ARRIVAL, preview)
    return count_and_first(rows, "error_type", "error_count", "example").orderBy(F.desc("error_count"), "error_type")


# --- times ---


def _timed(log: DataFrame) -> DataFrame:
    return log.filter("execution_time_ms > 0")


def execution_time_histogram(log: DataFrame) -> DataFrame:
    """Every bucket in its order, empty ones too, from one global aggregate."""
    bucket = fn.execution_time_bucket("execution_time_ms")
    labels = [label for _, label in rules.TIME_BUCKETS]
    row = _timed(log).select(bucket.alias("b")).agg(
        F.count(F.lit(1)).alias("total"),
        F.array(
            *(
                F.struct(F.lit(label).alias("bucket"), F.count_if(F.col("b") == label).alias("query_count"))
                for label in labels
            )
        ).alias("buckets"),
    )
    return row.select("total", F.posexplode("buckets").alias("pos", "x")).select(
        (F.col("pos") + 1).alias("rank"),
        "x.*",
        fn.share_pct(F.col("x.query_count"), F.col("total")).alias("pct"),
    )


_BLOCK_BITS = 18


def execution_time_stats(log: DataFrame) -> DataFrame:
    """Exact min, mean, max and the values at positions n//2 and int(0.95 n).

    Distinct values are counted first. Running totals are taken per block of
    2^18 ms, so one task orders at most that many values, and the only
    unpartitioned windows run over the blocks: one row per 4.4 minutes of duration.
    """
    values = _timed(log).groupBy("execution_time_ms").agg(F.count(F.lit(1)).alias("n"))
    values = values.withColumn("block", F.shiftright("execution_time_ms", _BLOCK_BITS))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        values.groupBy("block")
        .agg(F.sum("n").alias("n"))
        .select(
            "block",
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
            F.sum("n").over(Window.partitionBy()).alias("total"),
        )
    )
    upto = Window.partitionBy("block").orderBy("execution_time_ms").rowsBetween(
        Window.unboundedPreceding, 0
    )
    ranked = (
        values.withColumn("running", F.sum("n").over(upto))
        .join(blocks, "block")
        .withColumn("upto", F.col("before") + F.col("running"))
    )
    ms, total = F.col("execution_time_ms"), F.col("total")

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("upto") > position, ms))

    return ranked.agg(
        F.sum("n").alias("query_count"),
        F.min(ms).alias("min_ms"),
        (F.sum(ms * F.col("n")) / F.sum("n")).alias("avg_ms"),
        F.max(ms).alias("max_ms"),
        at(F.floor(total / 2)).alias("p50_ms"),
        at(F.floor(total * F.lit(0.95))).alias("p95_ms"),
    )


def execution_time_stats_fast(log: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """The same table in one pass with sketched percentiles."""
    ms = "execution_time_ms"
    return _timed(log).agg(
        F.count(F.lit(1)).alias("query_count"),
        F.min(ms).alias("min_ms"),
        F.avg(ms).alias("avg_ms"),
        F.max(ms).alias("max_ms"),
        F.percentile_approx(ms, 0.5, accuracy).alias("p50_ms"),
        F.percentile_approx(ms, 0.95, accuracy).alias("p95_ms"),
    )


def long_running_queries(log: DataFrame) -> DataFrame:
    return (
        log.filter("query_string <> ''")
        .withColumn("long_class", fn.long_running_class("execution_time_ms"))
        .filter(F.col("long_class").isNotNull())
        .select(
            *ARRIVAL,
            "query_id",
            "user_id",
            "execution_time_ms",
            "long_class",
            fn.long_running_minutes("execution_time_ms").alias("execution_time_min"),
            fn.truncate_preview("query_string", 500).alias("query_preview"),
        )
    )


def long_running_totals(log: DataFrame) -> DataFrame:
    """Queries of 10-30 minutes, of 30 minutes or more, and of an hour or more."""
    long = F.col("long_class")
    rows = log.filter("query_string <> ''").select(
        fn.long_running_class("execution_time_ms").alias("long_class")
    )
    return rows.agg(
        F.count_if(long == "over_10m").alias("from_10_to_30m"),
        F.count_if(long.isin("over_30m", "over_1h")).alias("over_30m"),
        F.count_if(long == "over_1h").alias("over_1h"),
    )


def longest_queries(log: DataFrame, k: int = 10) -> DataFrame:
    very_long = long_running_queries(log).filter(F.col("long_class") != "over_10m")
    return very_long.orderBy(F.desc("execution_time_ms"), *ARRIVAL).limit(k).drop(*ARRIVAL)


# --- volume ---


def _scans(log: DataFrame) -> DataFrame:
    return log.filter("query_string <> '' AND data_scanned > 0")


def data_scanned_by_user(log: DataFrame) -> DataFrame:
    return _scans(log).groupBy("user_id").agg(F.sum("data_scanned").alias("data_scanned"))


def data_scanned_by_workgroup(log: DataFrame) -> DataFrame:
    rows = _scans(log).filter("workgroup <> ''")
    return rows.groupBy("workgroup").agg(F.sum("data_scanned").alias("data_scanned"))


def data_scanned_stats(log: DataFrame) -> DataFrame:
    return _scans(log).agg(
        F.count(F.lit(1)).alias("query_count"),
        F.avg("data_scanned").alias("avg_bytes"),
        F.max("data_scanned").alias("max_bytes"),
        F.sum("data_scanned").alias("total_bytes"),
    )


def top_scanners(log: DataFrame, k: int = 10) -> DataFrame:
    ranked = top_k(data_scanned_by_user(log), "data_scanned", ["user_id"], k)
    return ranked.withColumn("data_scanned_text", fn.format_bytes("data_scanned"))


# --- time series ---


def _timed_counts(events: DataFrame, key: Column, name: str) -> DataFrame:
    rows = events.filter(F.col("event_time").isNotNull())
    return rows.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("event_count"))


def hourly_counts(events: DataFrame) -> DataFrame:
    return _timed_counts(events, fn.hour_key("event_time"), "hour")


def daily_counts(events: DataFrame) -> DataFrame:
    return _timed_counts(events, fn.day_key("event_time"), "day")


def minute_concurrency(events: DataFrame) -> DataFrame:
    """Events per minute: starts in a minute, not overlapping runs."""
    return _timed_counts(events, fn.minute_key("event_time"), "minute")


def peak_concurrency(events: DataFrame) -> DataFrame:
    peak = minute_concurrency(events).agg(F.max("event_count").alias("n"))
    return peak.select(F.coalesce("n", F.lit(0).cast("bigint")).alias("peak_concurrency"))


def analysis_period(*tables: DataFrame) -> DataFrame:
    """First and last event over all tables, and the days and hours between.

    Each table is folded to one row before the union.
    """
    spans = None
    for table in tables:
        span = table.agg(F.min("event_time").alias("first"), F.max("event_time").alias("last"))
        spans = span if spans is None else spans.unionByName(span)
    out = spans.agg(F.min("first").alias("earliest_event"), F.max("last").alias("latest_event"))
    seconds = F.timestamp_diff("SECOND", "earliest_event", "latest_event")
    return out.withColumns(
        {
            "days": F.floor(seconds / 86_400),
            "hours": F.floor((seconds % 86_400) / 3_600),
        }
    )


def avg_queries_per_day(queries: DataFrame, *tables: DataFrame) -> DataFrame:
    """Queries over whole days; 0 where the period is under a day."""
    total = queries.agg(F.count(F.lit(1)).alias("n")).scalar()
    days = F.col("days")
    return analysis_period(*tables).select(
        "days", F.when(days > 0, total / days).otherwise(F.lit(0.0)).alias("avg_queries_per_day")
    )
