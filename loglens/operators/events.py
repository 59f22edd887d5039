"""Raw audit records to clean event tables."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import MapType, StructType, TimestampType

from .. import functions as fn, rules, schemas


def unwrap_api_record(records: DataFrame, wrapped: str = "CloudTrailEvent") -> DataFrame:
    """Rows that carry the record as JSON text are parsed; others stay as they are.

    Columns that are no part of the record (the account, the file) are kept.
    """
    if wrapped not in records.columns:
        return records
    parsed = F.from_json(wrapped, schemas.RECORD)
    names = schemas.RECORD.fieldNames()
    kept = [c for c in records.columns if c not in names and c != wrapped]
    fields = []
    for name in names:
        inner = F.col("_record")[name]
        if name in records.columns:
            inner = F.when(F.col(wrapped).isNotNull(), inner).otherwise(F.col(name))
        fields.append(inner.alias(name))
    return records.withColumn("_record", parsed).select(*kept, *fields)


def unreadable_api_records(records: DataFrame, wrapped: str = "CloudTrailEvent") -> DataFrame:
    """Rows whose wrapped record is no JSON text: ``unwrap_api_record`` has nothing for them."""
    if wrapped not in records.columns:
        return records.limit(0)
    return records.filter(F.col(wrapped).isNotNull() & F.get_json_object(wrapped, "$").isNull())


def dedupe_events(
    events: DataFrame, key: str = "event_id", order_by: Sequence[str] = ("event_time",), places: int = 0
) -> DataFrame:
    """First row per non-empty id; rows without an id are all kept.

    Copies that differ are put in a whole order: ``order_by``, then a hash of the row, so
    the same row is kept however the input is dealt. The rank filter becomes a group limit
    on both sides of the shuffle, so an id with very many copies sends one row per task.
    Rows without an id pass by the shuffle; nothing depends on their place in the input.
    ``places``: the rows are first dealt by id and as many places an id, so no task sorts
    what it reads, which may be one large file; an id with many copies is still spread.
    One place saves a shuffle where an id is known to have few copies.
    """
    has_id = F.coalesce(F.col(key), F.lit("")) != ""
    whole = [
        F.sort_array(F.map_entries(f.name)) if isinstance(f.dataType, MapType) else F.col(f.name)
        for f in events.schema.fields
    ]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order_by, F.xxhash64(*whole)))
    rows = events.filter(has_id)
    if places == 1:
        rows = rows.repartition(key)
    elif places:
        dealt = rows.withColumn("_place", F.monotonically_increasing_id() % places)
        rows = dealt.repartition(key, "_place").drop("_place")
    first = rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    return first.unionByName(events.filter(~has_id))


def event_route(
    source: Column | str, name: Column | str, strict_source: bool = False
) -> Column:
    """'query' for the query service, 'store' for the object store, else null.

    A query-service event name alone routes a record unless ``strict_source``.
    """
    source = F.col(source) if isinstance(source, str) else source
    name = F.col(name) if isinstance(name, str) else name
    query = source == rules.QUERY_SOURCE
    if not strict_source:
        query = query | name.isin(*rules.QUERY_EVENT_NAMES)
    return F.when(F.coalesce(query, F.lit(False)), "query").when(
        (source == rules.STORE_SOURCE) & name.isin(*rules.STORE_EVENT_NAMES), "store"
    )


def route_events(records: DataFrame, strict_source: bool = False) -> DataFrame:
    """Adds ``route`` and drops the records that belong to neither service."""
    route = event_route("eventSource", "eventName", strict_source)
    return records.withColumn("route", route).filter("route IS NOT NULL")


def _account(records: DataFrame) -> Column:
    names = [c for c in ("account_id", "recipientAccountId") if c in records.columns]
    return F.coalesce(*(F.col(c) for c in names)) if names else F.lit(None).cast("string")


def _from_json(text: str, schema: StructType) -> Column:
    """The fields of a JSON text; a text as short as ``{}`` has none and is not parsed."""
    return F.when(F.length(text) > 2, F.from_json(text, schema))


def _parsed(records: DataFrame) -> DataFrame:
    return records.withColumns(
        {
            "_req": _from_json("requestParameters", schemas.REQUEST),
            "_res": _from_json("responseElements", schemas.RESPONSE),
            "_extra": _from_json("additionalEventData", schemas.TRANSFER),
        }
    )


def _common_columns(records: DataFrame) -> dict[str, Column]:
    return {
        "event_id": F.col("eventID"),
        "event_name": F.coalesce("eventName", F.lit("")),
        "event_time": fn.parse_event_time("eventTime"),
        "user_id": fn.user_id("userIdentity.arn", "userIdentity.principalId"),
        "account_id": _account(records),
    }


def _query_columns() -> dict[str, Column]:
    req, res = F.col("_req"), F.col("_res")
    run = res["queryExecution"]
    polled = F.coalesce(run["workGroup"], F.lit(rules.DEFAULT_WORKGROUP))
    return {
        "user_arn": F.coalesce("userIdentity.arn", F.lit(rules.UNKNOWN_USER)),
        "aws_region": F.coalesce("awsRegion", F.lit("")),
        "source_ip": F.coalesce("sourceIPAddress", F.lit("")),
        "workgroup": F.coalesce(req["workGroup"], F.lit(rules.DEFAULT_WORKGROUP)),
        "database": query_database(req["queryExecutionContext"]["database"]),
        "query_string": req["queryString"],
        "query_execution_id": F.coalesce(
            res["queryExecutionId"], run["queryExecutionId"], req["queryExecutionId"]
        ),
        "polled_workgroup": F.when(run.isNotNull(), polled),
        "polled_bytes": run["statistics"]["dataScannedInBytes"],
        "request_parameters": F.coalesce("requestParameters", F.lit("{}")),
        "response_elements": F.coalesce("responseElements", F.lit("{}")),
        "error_code": F.col("errorCode"),
    }


def _store_columns() -> dict[str, Column]:
    return {
        "bucket": F.coalesce("_req.bucketName", F.lit("")),
        "key": F.coalesce("_req.key", F.lit("")),
        "bytes_transferred": F.lit(None).cast("bigint"),
        "object_size": F.lit(None).cast("bigint"),
        "extra_bytes_in": F.col("_extra.bytesTransferredIn"),
        "extra_bytes_out": F.col("_extra.bytesTransferredOut"),
    }


def _select(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*(column.alias(name) for name, column in columns.items()))


def normalize_athena_events(records: DataFrame) -> DataFrame:
    """Query-service records as flat rows; request and response kept as JSON text."""
    return _select(_parsed(records), {**_common_columns(records), **_query_columns()})


def normalize_s3_events(records: DataFrame) -> DataFrame:
    """Object-store records as flat rows with bucket, key, user and volume."""
    return _select(_parsed(records), {**_common_columns(records), **_store_columns()})


def normalize_events(routed: DataFrame) -> DataFrame:
    """Routed records of both services as one flat table, each parsed once."""
    columns = {**_common_columns(routed), **_query_columns(), **_store_columns()}
    return _select(_parsed(routed), {"route": F.col("route"), **columns})


def split_events(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Query and store events of a table written from ``normalize_events``."""
    store_only, query_only = set(_store_columns()), set(_query_columns())
    folders = ("route", "event_date")
    queries = landed.filter("route = 'query'").drop(*folders, *store_only)
    return queries, landed.filter("route = 'store'").drop(*folders, *query_only)


def query_database(name: Column | str) -> Column:
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(rules.DEFAULT_DATABASE))


def workgroup_allowed(allowed: Collection[str], workgroup: Column | str = "workgroup") -> Column:
    if "*" in allowed:
        return F.lit(True)
    workgroup = F.col(workgroup) if isinstance(workgroup, str) else workgroup
    return F.coalesce(workgroup, F.lit(rules.DEFAULT_WORKGROUP)).isin(*allowed)


def workgroup_allow_list(events: DataFrame, allowed: Collection[str] = ("*",)) -> DataFrame:
    return events.filter(workgroup_allowed(allowed))


def skipped_workgroups(events: DataFrame, allowed: Collection[str]) -> DataFrame:
    name = F.coalesce("workgroup", F.lit(rules.DEFAULT_WORKGROUP)).alias("workgroup")
    return events.filter(~workgroup_allowed(allowed)).select(name).distinct()


def bucket_monitored(allowed: Collection[str], bucket: Column | str = "bucket") -> Column:
    """With '*': the name holds one of the fixed words, in any case; else the list."""
    bucket = F.coalesce(F.col(bucket) if isinstance(bucket, str) else bucket, F.lit(""))
    if "*" in allowed:
        low = F.lower(bucket)
        return reduce(or_, (low.contains(word) for word in rules.BUCKET_WORDS))
    return bucket.isin(*allowed)


def bucket_filter(events: DataFrame, allowed: Collection[str] = ("*",)) -> DataFrame:
    return events.filter(bucket_monitored(allowed))


def skipped_buckets(events: DataFrame, allowed: Collection[str] = ("*",)) -> DataFrame:
    removed = events.filter(~bucket_monitored(allowed) & (F.col("bucket") != ""))
    return removed.select("bucket").distinct()


@dataclass(frozen=True)
class Period:
    """A checked analysis period, both ends included."""

    start: datetime
    end: datetime

    @classmethod
    def of(cls, start: str, end: str, max_days: int | None = None) -> Period:
        """From ISO text. Bad text and reversed periods are errors, and periods over
        ``max_days`` where that is given."""
        try:
            first, last = (
                datetime.fromisoformat(str(text).replace("Z", "+00:00")) for text in (start, end)
            )
        except (ValueError, TypeError) as error:
            raise ValueError("start and end must be ISO-8601 times") from error
        first, last = (
            t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)
            for t in (first, last)
        )
        if max_days is not None and (last - first).days > max_days:
            raise ValueError(f"the period is over {max_days} days")
        if first >= last:
            raise ValueError("start must be before end")
        return cls(first, last)

    @classmethod
    def last_days(cls, days: int = rules.LOOKBACK_DAYS, now: datetime | None = None) -> Period:
        end = now or datetime.now(timezone.utc)
        return cls(end - timedelta(days=days), end)

    @classmethod
    def last_minutes(
        cls, minutes: int = rules.LOOKBACK_MINUTES, now: datetime | None = None
    ) -> Period:
        end = now or datetime.now(timezone.utc)
        return cls(end - timedelta(minutes=minutes), end)

    def days(self) -> list[datetime]:
        """Every UTC day the period touches, the last one too."""
        day = self.start.replace(hour=0, minute=0, second=0, microsecond=0)
        out = []
        while day <= self.end:
            out.append(day)
            day += timedelta(days=1)
        return out


def time_range_filter(events: DataFrame, period: Period, column: str = "event_time") -> DataFrame:
    """Rows inside the period; the ends are cast to the column's own type so
    that the comparison reaches the file scan. They name their zone where the
    type has one, so the session's zone does not matter."""
    kind = events.schema[column].dataType
    zone = "+00:00" if isinstance(kind, TimestampType) else ""

    def end(t: datetime) -> Column:
        return F.lit(t.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f") + zone).cast(kind)

    return events.filter(F.col(column).between(end(period.start), end(period.end)))


def positive_measures(events: DataFrame, column: str) -> DataFrame:
    return events.filter(F.col(column) > 0)
