"""Aggregates over object-store events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import functions as fn, rules
from .members import count_members, member_rows
from .ranking import top_k

_OPS = ("get", "put", "list")


def store_operations(events: DataFrame) -> DataFrame:
    """Adds the operation, its 0/1 counters and the bytes in and out.

    A zero or missing transfer falls back to the field of its direction.
    """
    op = fn.s3_operation("event_name")
    rows = events.filter(F.coalesce("bucket", F.lit("")) != "").withColumn("operation", op)
    is_op = {name: F.col("operation") == name for name in _OPS}

    def flag(hit: Column) -> Column:
        return F.coalesce(hit.cast("bigint"), F.lit(0))

    return rows.withColumns(
        {
            **{f"{name}_count": flag(hit) for name, hit in is_op.items()},
            "bytes_out": F.when(is_op["get"], fn.nonzero("bytes_transferred", "extra_bytes_out")).otherwise(0),
            "bytes_in": F.when(is_op["put"], fn.nonzero("bytes_transferred", "extra_bytes_in")).otherwise(0),
        }
    )


def s3_bucket_stats(events: DataFrame) -> DataFrame:
    rows = store_operations(events).withColumn("prefix", fn.object_prefix("key"))
    counters = [f"{op}_count" for op in _OPS]
    return count_members(
        member_rows(rows, ["bucket"], {"prefix": "prefix", "user": "user_id"}, counters),
        ["bucket"],
        {"prefix": "unique_prefixes", "user": "unique_users"},
        counters,
    )


def s3_bucket_bytes(events: DataFrame) -> DataFrame:
    return store_operations(events).groupBy("bucket").agg(
        F.sum("bytes_out").alias("bytes_out"), F.sum("bytes_in").alias("bytes_in")
    )


def s3_totals(events: DataFrame) -> DataFrame:
    return store_operations(events).agg(
        F.coalesce(F.sum(sum(F.col(f"{op}_count") for op in _OPS)), F.lit(0)).alias(
            "total_operations"
        ),
        F.coalesce(F.sum("bytes_out"), F.lit(0)).alias("bytes_read"),
        F.coalesce(F.sum("bytes_in"), F.lit(0)).alias("bytes_written"),
    )


def object_size_stats(events: DataFrame) -> DataFrame:
    """Number, mean and small-file share of the objects read and written."""
    rows = store_operations(events).filter(F.col("operation").isin("get", "put"))
    size = fn.nonzero("object_size", "bytes_out", "bytes_in")
    sizes = rows.select(size.alias("object_bytes")).filter("object_bytes > 0")
    small = F.count_if(F.col("object_bytes") < rules.SMALL_OBJECT_BYTES)
    out = sizes.agg(
        F.count(F.lit(1)).alias("object_count"),
        F.avg("object_bytes").alias("avg_object_bytes"),
        small.alias("small_count"),
    )
    mean = F.col("avg_object_bytes")
    tier = (
        F.when(mean < rules.SMALL_OBJECT_BYTES, "under 10 MiB")
        .when(mean < rules.MEDIUM_OBJECT_BYTES, "under 50 MiB")
        .when(mean.isNotNull(), "ok")
    )
    return out.withColumns(
        {"small_pct": fn.share_pct(F.col("small_count"), F.col("object_count")), "tier": tier}
    )


def top_buckets(events: DataFrame, k: int = 10) -> DataFrame:
    stats = s3_bucket_stats(events).withColumn(
        "total_count", sum(F.col(f"{op}_count") for op in _OPS)
    )
    return top_k(stats, "total_count", ["bucket"], k)
