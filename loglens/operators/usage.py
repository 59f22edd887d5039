"""Aggregates over events and query facts: workgroup, user, database, pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import functions as fn
from ..session import store_table
from .members import count_members, distinct_members, member_rows
from .ranking import first_k, global_rank, top_k


def workgroup_stats(facts: DataFrame) -> DataFrame:
    return facts.groupBy("workgroup").agg(
        F.count(F.lit(1)).alias("query_count"),
        F.countDistinct("user_id").alias("unique_users"),
        F.sum("data_scanned").alias("total_data_scanned"),
    )


def workgroup_query_types(facts: DataFrame) -> DataFrame:
    kind = fn.classify_query("query").alias("query_type")
    return facts.groupBy("workgroup", kind).agg(F.count(F.lit(1)).alias("query_count"))


def query_type_map(types: DataFrame) -> DataFrame:
    """One map per workgroup; there are only a dozen statement types."""
    entry = F.struct("query_type", "query_count")
    return types.groupBy("workgroup").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("query_types")
    )


def query_type_counts(facts: DataFrame) -> DataFrame:
    kind = fn.classify_query("query").alias("query_type")
    return facts.groupBy(kind).agg(F.count(F.lit(1)).alias("query_count"))


def user_activity(events: DataFrame) -> DataFrame:
    """Events (not queries) per user and the last of them."""
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.max("event_time").alias("last_activity")
    )


def user_first_last_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(
        F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen")
    )


def user_scope(facts: DataFrame) -> DataFrame:
    rows = member_rows(facts, ["user_id"], {"workgroup": "workgroup", "database": "database"})
    return count_members(
        rows, ["user_id"], {"workgroup": "unique_workgroups", "database": "unique_databases"}
    )


def user_scope_members(facts: DataFrame) -> DataFrame:
    """The workgroups and databases themselves, one row each."""
    return distinct_members(facts, ["user_id"], {"workgroup": "workgroup", "database": "database"})


def table_references(facts: DataFrame) -> DataFrame:
    """One row per query and table."""
    return facts.select(
        "query_execution_id", F.explode(fn.extract_tables("query")).alias("table_name")
    )


def with_text_columns(facts: DataFrame) -> DataFrame:
    """Facts with the fingerprint and the tables of their text, as far as they lack them: facts
    stored with them are not matched again by each report."""
    read = {"pattern_hash": fn.query_fingerprint("query"), "tables": fn.extract_tables("query")}
    return facts.withColumns({name: value for name, value in read.items() if name not in facts.columns})


def _counted(facts: DataFrame) -> DataFrame:
    return with_text_columns(facts).withColumn("query_count", F.lit(1).cast("bigint"))


def database_stats(facts: DataFrame) -> DataFrame:
    rows = member_rows(
        _counted(facts), ["database"], {"table": "tables", "user": "user_id"}, ["query_count"]
    )
    return count_members(
        rows,
        ["database"],
        {"table": "unique_tables", "user": "unique_users"},
        ["query_count"],
    )


def query_patterns(facts: DataFrame) -> DataFrame:
    """Per fingerprint: counts, sums and the average time."""
    measures = ["query_count", "data_scanned", "execution_time_ms"]
    rows = member_rows(
        _counted(facts),
        ["pattern_hash"],
        {"user": "user_id", "workgroup": "workgroup", "database": "database", "table": "tables"},
        measures,
    )
    folded = count_members(
        rows,
        ["pattern_hash"],
        {
            "user": "unique_users",
            "workgroup": "unique_workgroups",
            "database": "unique_databases",
            "table": "unique_tables",
        },
        measures,
    )
    return folded.withColumnsRenamed(
        {"data_scanned": "total_data_scanned", "execution_time_ms": "total_execution_time_ms"}
    ).withColumn("avg_execution_time_ms", F.col("total_execution_time_ms") / F.col("query_count"))


def pattern_examples(facts: DataFrame, k: int = 5) -> DataFrame:
    """First k distinct masked texts per fingerprint, in order of arrival; texts are
    compared whole."""
    seen = (
        with_text_columns(facts)
        .select(
            "pattern_hash",
            fn.masked_query("query").alias("masked"),
            F.struct("event_time", "event_id").alias("arrival"),
        )
        .select("pattern_hash", "masked.*", "arrival")
        .groupBy("pattern_hash", "example", "digest")
        .agg(F.min("arrival").alias("arrival"))
    )
    return first_k(seen, ["pattern_hash"], ["arrival", "digest"], k).drop("arrival", "digest")


def ranked_patterns(facts: DataFrame) -> DataFrame:
    """All patterns numbered by count. Ranking reads the patterns three times,
    so they are stored first."""
    patterns = store_table(query_patterns(facts), "patterns")
    return global_rank(patterns, "query_count", "pattern_hash")


def top_patterns(facts: DataFrame, k: int = 15) -> DataFrame:
    return top_k(query_patterns(facts), "query_count", ["pattern_hash"], k)


def top_workgroups_by_queries(facts: DataFrame, k: int = 10) -> DataFrame:
    return top_k(workgroup_stats(facts), "query_count", ["workgroup"], k)


def top_workgroups_by_data(facts: DataFrame, k: int = 10) -> DataFrame:
    gb = F.col("total_data_scanned") / F.lit(float(1024**3))
    ranked = top_k(workgroup_stats(facts), "total_data_scanned", ["workgroup"], k)
    return ranked.select("workgroup", "total_data_scanned", gb.alias("data_scanned_gb"))


def top_types_per_workgroup(facts: DataFrame, k: int = 3) -> DataFrame:
    return first_k(
        workgroup_query_types(facts), ["workgroup"], [F.desc("query_count"), "query_type"], k
    )


def top_users(events: DataFrame, facts: DataFrame, k: int = 15, shown: int = 3) -> DataFrame:
    """Users by event count with their first workgroups in name order."""
    users = top_k(user_activity(events), "event_count", ["user_id"], k)
    groups = facts.groupBy("user_id", "workgroup").agg(F.count(F.lit(1)).alias("n"))
    kept = first_k(groups.join(users, "user_id", "left_semi"), ["user_id"], ["workgroup"], shown + 1)
    few = kept.groupBy("user_id").agg(
        F.array_sort(F.collect_list("workgroup")).alias("groups")
    )
    names = F.coalesce("groups", F.array().cast("array<string>"))
    text = F.concat(
        F.array_join(F.slice(names, 1, shown), ", "),
        F.when(F.size(names) > shown, "...").otherwise(""),
    )
    return users.join(few, "user_id", "left").select(
        "user_id", "event_count", "last_activity", text.alias("workgroups")
    )


def top_databases(facts: DataFrame, k: int = 10) -> DataFrame:
    return top_k(database_stats(facts), "query_count", ["database"], k)
