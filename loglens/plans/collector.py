"""Audit records to facts: the shared front part of every collector report."""

from __future__ import annotations

from collections.abc import Collection, Iterator, Mapping
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import events as ev, facts as fc, usage
from ..operators.events import Period

OPEN_FOLDERS = 16


class Collected:
    """Clean tables of one run. Each is planned when first asked for, lazy."""

    def __init__(
        self,
        queries: DataFrame,
        store: DataFrame,
        stats: DataFrame,
        workgroups: Collection[str],
        buckets: Collection[str],
        period: Period | None = None,
    ):
        self._queries, self._store, self._stats = queries, store, stats
        self._workgroups, self._buckets, self._period = workgroups, buckets, period

    @cached_property
    def events(self) -> DataFrame:
        # Copies share their workgroup, so filtering first only saves work.
        return ev.dedupe_events(ev.workgroup_allow_list(self._queries, self._workgroups))

    @cached_property
    def store_events(self) -> DataFrame:
        return ev.dedupe_events(ev.bucket_filter(self._store, self._buckets))

    @cached_property
    def starts(self) -> DataFrame:
        # Folding starts by execution id also folds the copies of an event, so
        # the texts need not be shuffled by event id first.
        return fc.query_starts(ev.workgroup_allow_list(self._queries, self._workgroups))

    @cached_property
    def enriched(self) -> DataFrame:
        return fc.enrich_queries(self.starts, self._stats)

    @cached_property
    def facts(self) -> DataFrame:
        return fc.query_facts(self.enriched)

    @cached_property
    def analysis_period(self) -> DataFrame:
        """One row: the period asked for; nulls where the run has none."""
        ends = (self._period.start, self._period.end) if self._period else (None, None)
        spark = self._queries.sparkSession
        return spark.createDataFrame([ends], "period_start timestamp, period_end timestamp")

    def configuration(self, settings: Mapping[str, str] | None = None) -> DataFrame:
        """(setting, value): a row for each monitored workgroup and bucket and each of ``settings``."""
        rows = [("monitored_workgroups", name) for name in self._workgroups]
        rows += [("monitored_s3_buckets", name) for name in self._buckets]
        rows += [(name, value) for name, value in (settings or {}).items()]
        spark = self._queries.sparkSession
        return spark.createDataFrame(rows, "setting string, value string")

    @cached_property
    def skipped_workgroups(self) -> DataFrame:
        return ev.skipped_workgroups(self._queries, self._workgroups)

    @cached_property
    def skipped_buckets(self) -> DataFrame:
        return ev.skipped_buckets(self._store, self._buckets)


    def stored(self, path: str) -> Collected:
        """The same run over written tables: the log is read once, and the many
        reports that follow start from clean events and facts."""
        out = Collected(
            self._queries, self._store, self._stats, self._workgroups, self._buckets, self._period
        )

        def write(name: str, table: DataFrame) -> DataFrame:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
            return table.sparkSession.read.parquet(f"{path}/{name}")

        out.events = write("events", self.events)
        out.starts = fc.query_starts(out.events)
        out.store_events = write("store_events", self.store_events)
        out.facts = write("facts", usage.with_text_columns(out.facts))
        return out


def land_records(
    records: DataFrame, path: str, strict_source: bool = False, by_day: bool = True
) -> DataFrame:
    """Write the flat events once as Parquet, in folders by route and day.

    The JSON is parsed a single time however many reports follow. A task reads small
    files of many days and accounts, so the records are gathered by folder before they are
    written: files are of even size, and a folder much larger than the rest is split. They
    are gathered as they came, since a flat row also repeats what its JSON texts hold, by
    the date as it is written. A task then meets few folders and keeps a file open for each,
    so nothing is sorted by folder unless it meets more than ``OPEN_FOLDERS``.
    Give the result to ``collect_usage`` in place of the records; a period then opens
    only its own days.
    """
    flat, folders = _gathered(records, strict_source, by_day)
    with _setting(records.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", OPEN_FOLDERS):
        flat.write.mode("overwrite").partitionBy(*folders).parquet(path)
    return records.sparkSession.read.schema(flat.schema).parquet(path)


def _gathered(records: DataFrame, strict_source: bool, by_day: bool) -> tuple[DataFrame, list[str]]:
    """The flat events, read from records gathered by folder, and the columns of the folder."""
    routed = ev.route_events(ev.unwrap_api_record(records), strict_source)
    if not by_day:
        return ev.normalize_events(routed.hint("rebalance", F.col("route"))), ["route"]
    near = routed.withColumn("_day", F.substring("eventTime", 1, 10))
    flat = ev.normalize_events(near.hint("rebalance", F.col("route"), F.col("_day")))
    return flat.withColumn("event_date", F.to_date("event_time")), ["route", "event_date"]


@contextmanager
def _setting(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _empty_stats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [],
        "query_execution_id string, query string, workgroup string, database string, "
        "status string, data_scanned bigint, execution_time_ms bigint",
    )


def collect_usage(
    records: DataFrame,
    stats: DataFrame | None = None,
    workgroups: Collection[str] = ("*",),
    buckets: Collection[str] = ("*",),
    period: Period | None = None,
    strict_source: bool = False,
) -> Collected:
    """unwrap, route, flatten, deduplicate, filter, join. ``records`` are raw
    audit records or the table ``land_records`` wrote.

    Routing comes before the deduplication, so records of other services are
    gone before the shuffle, and copies always route alike.
    """
    if "route" in records.columns:
        if period is not None and "event_date" in records.columns:
            records = records.filter(
                F.col("event_date").between(period.start.date(), period.end.date())
            )
        queries, store = ev.split_events(records)
    else:
        routed = ev.route_events(ev.unwrap_api_record(records), strict_source)
        queries = ev.normalize_athena_events(routed.filter("route = 'query'"))
        store = ev.normalize_s3_events(routed.filter("route = 'store'"))
    if period is not None:
        queries = ev.time_range_filter(queries, period)
        store = ev.time_range_filter(store, period)
    stats = _empty_stats(records.sparkSession) if stats is None else stats
    return Collected(queries, store, stats, workgroups, buckets, period)


def summary_sections(
    run: Collected,
    errors: DataFrame | None = None,
    settings: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """The sections of a run's summary, sets as rows of their own tables.

    ``errors`` are the files with problems of a scan (``audit_problems``), kept with their
    path and problem; ``settings`` join the configuration (mode, way over accounts).
    """
    from ..operators.overview import overview
    from ..operators.querylog import hourly_counts
    from ..operators.store import s3_bucket_stats

    if errors is None:
        spark = run.events.sparkSession
        errors = spark.createDataFrame([], "path string, problem string")
    return {
        "analysis_period": run.analysis_period,
        "configuration": run.configuration(settings),
        "errors": errors.select("path", "problem"),
        "overview": overview(
            run.events,
            run.store_events,
            run.starts,
            run.facts,
            run.skipped_workgroups,
            run.skipped_buckets,
        ),
        "workgroup_stats": usage.workgroup_stats(run.facts),
        "workgroup_query_types": usage.workgroup_query_types(run.facts),
        "user_stats": usage.user_activity(run.events),
        "user_scope": usage.user_scope_members(run.facts),
        "database_stats": usage.database_stats(run.facts),
        "query_patterns": usage.query_patterns(run.facts),
        "pattern_examples": usage.pattern_examples(run.facts),
        "s3_bucket_stats": s3_bucket_stats(run.store_events),
        "hourly_query_counts": hourly_counts(run.events),
        "skipped_workgroups": run.skipped_workgroups,
        "skipped_buckets": run.skipped_buckets,
    }
