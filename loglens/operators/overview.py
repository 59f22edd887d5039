"""Totals over all tables, in all and per account; merging of partial results."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import functions as fn, rules
from .members import count_members, member_rows
from .querylog import classify_log
from .ranking import first_k
from .usage import with_text_columns

_TOTALS = (
    "total_athena_events",
    "total_s3_events",
    "query_execution_ids_found",
    "queries_fetched_from_athena",
)
_DISTINCT = {
    "user": "unique_users",
    "workgroup": "unique_workgroups",
    "database": "unique_databases",
    "pattern": "unique_query_patterns",
    "bucket": "unique_buckets",
}


def _overview(
    keys: Sequence[str],
    events: DataFrame,
    store_events: DataFrame,
    starts: DataFrame,
    facts: DataFrame,
) -> DataFrame:
    """Each table gives its row count and its distinct members in one pass."""

    def part(df: DataFrame, total: str, members: dict[str, str]) -> DataFrame:
        rows = df.withColumns(
            {t: F.lit(1 if t == total else 0).cast("bigint") for t in _TOTALS}
        )
        return member_rows(rows, keys, members, _TOTALS)

    parts = (
        part(events, "total_athena_events", {"user": "user_id"}),
        part(store_events, "total_s3_events", {"bucket": "bucket"}),
        part(starts, "query_execution_ids_found", {}),
        part(
            with_text_columns(facts),
            "queries_fetched_from_athena",
            {"workgroup": "workgroup", "database": "database", "pattern": "pattern_hash"},
        ),
    )
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return count_members(rows, keys, _DISTINCT, _TOTALS)


def overview(
    events: DataFrame,
    store_events: DataFrame,
    starts: DataFrame,
    facts: DataFrame,
    skipped_workgroups: DataFrame,
    skipped_buckets: DataFrame,
) -> DataFrame:
    """One row of totals; 0 where a table is empty."""
    row = _overview([], events, store_events, starts, facts)
    count = F.count(F.lit(1)).alias("n")
    return row.select(
        *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in _TOTALS),
        *_DISTINCT.values(),
        skipped_workgroups.agg(count).scalar().alias("skipped_workgroups_count"),
        skipped_buckets.agg(count).scalar().alias("skipped_buckets_count"),
    )


def per_account_overview(
    events: DataFrame, store_events: DataFrame, starts: DataFrame, facts: DataFrame
) -> DataFrame:
    return _overview(["account_id"], events, store_events, starts, facts)


# Levels of the roll-up: (level, name, the members it counts), all columns of a fact.
_ROLLUP = (
    ("workgroup", "workgroup", "user_id"),
    ("database", "database", "user_id"),
    ("user", "user_id", "workgroup"),
    ("user_database", "user_id", "database"),
    ("pattern", "pattern_hash", "user_id"),
    ("query_type", "query_type", "user_id"),
)


def account_rollup(facts: DataFrame, events: DataFrame, store_events: DataFrame) -> DataFrame:
    """Per account and for all of them ('ALL'): workgroups, users with their workgroups and
    databases, databases with their users and tables, patterns, statement types, hours of
    the events and buckets of the object store.

    Each table is read once; its rows are folded to (account, level, name, member), the total
    over accounts is a second grouping set over those folded rows. A user's last activity is
    the latest of their events.
    """
    keys, measures = ["account_id", "level", "name"], ["query_count", "data_scanned"]
    entry = "named_struct('level', '{}', 'name', {}, 'other', {})"
    entities = [entry.format(level, name, f"array({other})") for level, name, other in _ROLLUP]
    entities.append(entry.format("database_table", "database", "tables"))
    known = with_text_columns(facts).withColumn("query_type", fn.classify_query("query"))
    one = F.lit(1).cast("bigint").alias("query_count")
    counted = known.select("account_id", one, "data_scanned", F.expr(f"inline(array({', '.join(entities)}))"))
    no_time = F.lit(None).cast(events.schema["event_time"].dataType)
    rows = member_rows(counted, keys, {"member": "other"}, measures).withColumn(_LAST, no_time)
    rows = rows.unionByName(_rollup_events(events, "hour", fn.hour_key("event_time"), no_time, F.col("event_time")))
    rows = rows.unionByName(_rollup_events(store_events, "bucket", F.col("bucket"), no_time))
    group = ["level", "name", "kind", "member"]
    both = rows.groupingSets([["account_id", *group], group], "account_id", *group).agg(
        *(F.sum(m).alias(m) for m in measures), F.max(_LAST).alias(_LAST), F.grouping("account_id").alias("_all")
    )
    account = F.when(F.col("_all") == 1, "ALL").otherwise(F.col("account_id"))
    folded = both.withColumn("account_id", account).groupBy(*keys).agg(
        *(F.sum(m).alias(m) for m in measures),
        F.count_if(F.col("kind") == "member").alias("unique_members"),
        F.max(_LAST).alias(_LAST),
    )
    return folded.filter("query_count IS NOT NULL")


_LAST = "last_activity"


def _rollup_events(
    events: DataFrame, level: str, name: Column, no_time: Column, activity: Column | None = None
) -> DataFrame:
    """Folded rows of one level with the users as members; given the time of an ``activity``,
    also rows that hold nothing but the last one of each user."""
    no_count = F.lit(None).cast("bigint")

    def item(level: str, name: Column, kind: str, member: Column, n: Column, last: Column) -> Column:
        fields = {"level": F.lit(level), "name": name, "kind": F.lit(kind), "member": member, "query_count": n, _LAST: last}
        return F.struct(*(value.alias(key) for key, value in fields.items()))

    items = [
        item(level, name, "", F.lit(""), F.lit(1).cast("bigint"), no_time),
        item(level, name, "member", F.col("user_id"), no_count, no_time),
    ]
    if activity is not None:
        items.append(item("user", F.col("user_id"), "", F.lit(""), no_count, activity))
    rows = events.select("account_id", F.inline(F.array(*items))).filter("name IS NOT NULL AND member IS NOT NULL")
    return rows.groupBy("account_id", "level", "name", "kind", "member").agg(
        F.sum("query_count").alias("query_count"), no_count.alias("data_scanned"), F.max(_LAST).alias(_LAST)
    )


# Map sections of a summary: (column, members in each entry, sums in each entry).
_SECTIONS = {
    "workgroup": ("workgroup_stats", {"user": "users"}, ["query_count", "total_data_scanned"]),
    "user": ("user_stats", {"workgroup": "workgroups", "database": "databases"}, ["query_count"]),
    "database": ("database_stats", {"table": "tables", "user": "users"}, ["query_count"]),
    "pattern": (
        "query_patterns",
        {"user": "users", "workgroup": "workgroups", "database": "databases", "table": "tables"},
        ["count", "total_data_scanned", "total_execution_time_ms"],
    ),
    "bucket": (
        "s3_bucket_stats",
        {"user": "users", "prefix": "prefixes"},
        ["get_count", "put_count", "list_count", "bytes_in", "bytes_out"],
    ),
}


def merge_section(summaries: DataFrame, section: str) -> DataFrame:
    """Sum one section over many summaries; members are counted once."""
    column, members, measures = _SECTIONS[section]
    entries = summaries.select(F.explode(column).alias("name", "entry")).select("name", "entry.*")
    rows = member_rows(entries, ["name"], members, measures)
    return count_members(rows, ["name"], {k: f"unique_{column}" for k, column in members.items()}, measures)


# A cell is one number of an entry, or one of its members. A member's cell has no value; the
# cell without a member says that the entry is there, so that a count of none is 0.
CELL = ["section", "name", "part", "measure", "counted", "member"]
_CELLS = "array<struct<section:string,name:string,part:string,measure:string,counted:boolean,member:string,value:bigint>>"


def _number(section: str, name: Column, measure: str, value: Column, part: Column | None = None) -> Column:
    text, none = F.lit, F.lit(None)
    return F.struct(
        text(section), name, none if part is None else part, text(measure), F.lit(False), none, value.cast("bigint")
    )


def _members(section: str, name: Column, column: str, values: Column) -> Column:
    def cell(member: Column) -> Column:
        return F.struct(
            F.lit(section), name, F.lit(None), F.lit(f"unique_{column}"), F.lit(True), member, F.lit(None).cast("bigint")
        )

    return F.concat(F.array(cell(F.lit(None))).cast(_CELLS), F.coalesce(F.transform(values, cell).cast(_CELLS), _no_cells()))


def _no_cells() -> Column:
    return F.array().cast(_CELLS)


def _cells_of(column: str, cells: Callable[[Column, Column], Column]) -> Column:
    """The cells of all entries of a map column; none of a null."""
    entries = F.transform(F.map_entries(column), lambda e: cells(e["key"], e["value"]))
    return F.coalesce(F.flatten(entries), _no_cells())


def _entry_cells(section: str, column: str, members: Mapping[str, str], measures: Sequence[str]) -> Column:
    def cells(name: Column, entry: Column) -> Column:
        numbers = F.array(*(_number(section, name, m, entry[m]) for m in measures)).cast(_CELLS)
        return F.concat(numbers, *(_members(section, name, c, entry[c]) for c in members.values()))

    return _cells_of(column, cells)


def _type_cells(name: Column, entry: Column) -> Column:
    types = F.transform(
        F.map_entries(entry["query_types"]), lambda t: _number("query_type", name, "query_count", t["value"], t["key"])
    )
    return F.coalesce(types.cast(_CELLS), _no_cells())


def _hour_cells(name: Column, n: Column) -> Column:
    return F.array(_number("hour", name, "query_count", n)).cast(_CELLS)


def summary_cells(summaries: DataFrame, *kept: str) -> DataFrame:
    """All sections of all summaries as cells, with the columns ``kept``; each summary is read once."""
    parts = [_entry_cells(section, *fields) for section, fields in _SECTIONS.items()]
    parts.append(_cells_of("workgroup_stats", _type_cells))
    parts.append(_cells_of("hourly_query_counts", _hour_cells))
    return summaries.select(*kept, F.inline(F.concat(*parts)))


def fold_cells(cells: DataFrame, *keys: str) -> DataFrame:
    """One row per number and per member, for each value of ``keys``. Folds of parts may be
    stored and folded again; an entry of a third of all rows is spread over its members."""
    return cells.groupBy(*keys, *CELL).agg(F.sum("value").alias("value"))


def merge_cells(cells: DataFrame) -> DataFrame:
    """(section, name, measure, value): numbers are summed, members are counted once."""
    entry = [c for c in CELL if c != "member"]
    value = F.when(F.col("counted"), F.count("member")).otherwise(F.sum("value"))
    merged = fold_cells(cells).groupBy(*entry).agg(value.alias("value"))
    return merged.filter("value IS NOT NULL").select(
        "section", F.concat_ws("/", "name", "part").alias("name"), "measure", "value"
    )


def merge_export_summaries(summaries: DataFrame) -> DataFrame:
    """All sections with all their numbers in one table: (section, name, measure, value)."""
    return merge_cells(summary_cells(summaries))


def _pattern_entries(summaries: DataFrame) -> DataFrame:
    return summaries.select("file", F.explode("query_patterns").alias("name", "entry")).select("file", "name", "entry.*")


def merge_pattern_examples(summaries: DataFrame, k: int = 3) -> DataFrame:
    """First k distinct examples of each pattern, in order of the files and in each of them."""
    rows = _pattern_entries(summaries).select("file", "name", F.posexplode("examples").alias("place", "example"))
    seen = rows.groupBy("name", "example").agg(F.min(F.struct("file", "place")).alias("arrival"))
    return first_k(seen, ["name"], ["arrival", "example"], k).select("name", "rank", "example")


def summary_queries(summaries: DataFrame) -> DataFrame:
    """The examples of all patterns as queries. An exported event has no text of its own, so
    these are the texts of such an export. A query has the mean time of its pattern in its
    file and the first of its users; it counts once."""
    entries = _pattern_entries(summaries)
    return entries.select(
        F.explode("examples").alias("query_string"),
        F.coalesce(F.get("users", F.lit(0)), F.lit(rules.UNKNOWN_USER)).alias("user_id"),
        (F.coalesce("total_execution_time_ms", F.lit(0)) / F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)))
        .cast("bigint").alias("execution_time_ms"),
        F.lit(None).cast("timestamp_ntz").alias("event_time"),
    )


def summary_example_tags(summaries: DataFrame) -> DataFrame:
    """(kind, tag, query_count) over the examples of all patterns: features, flags, statement
    kinds of DDL, partition columns, complexity and long-running classes."""
    tagged = classify_log(summary_queries(summaries))
    complexity, parted = F.col("complexity"), F.col("partitions")
    high = (complexity["join_count"] >= rules.HIGH_COMPLEXITY) | (complexity["subquery_count"] >= rules.HIGH_COMPLEXITY)

    def tags(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("tag")))

    def when(kind: str, hit: Column, tag: Column | str) -> Column:
        value = F.lit(tag) if isinstance(tag, str) else tag
        return tags(kind, F.when(F.coalesce(hit, F.lit(False)), F.array(value)).otherwise(F.array().cast("array<string>")))

    long = fn.long_running_class("execution_time_ms")
    all_tags = F.concat(
        tags("feature", F.col("features")), tags("flag", F.col("flags")), tags("partition", parted["filters"]),
        when("ddl", F.col("ddl").isNotNull(), F.col("ddl.type")), when("complexity", high, "high"),
        when("partition_use", parted["likely_full_scan"], "full_scan"), when("long_running", long.isNotNull(), long),
    )
    rows = tagged.select(F.explode_outer(all_tags).alias("t")).filter("t IS NOT NULL").select("t.*")
    return rows.groupBy("kind", "tag").agg(F.count(F.lit(1)).alias("query_count"))


def per_account_first_source(rows: DataFrame) -> DataFrame:
    """Per-account rows of many exports, read in file order.

    ``rows``: (file, source, account_id, ...), source 'summary' or 'member'.
    All summary rows are kept. The separate member counts only for the first
    file that has one, and only if no summary row came from that file or an
    earlier one.
    """
    first = {
        source: rows.filter(F.col("source") == source).agg(F.min("file").alias("f")).scalar()
        for source in ("summary", "member")
    }
    use_member = (F.col("file") == first["member"]) & (
        first["summary"].isNull() | (first["summary"] > F.col("file"))
    )
    return rows.filter((F.col("source") == "summary") | use_member)
