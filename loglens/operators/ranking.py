"""Ranked tables: top k, first k per group, and whole-table ranks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import for_workers

ARRIVAL = ("event_time", "event_id")
SPREAD = 32


def top_k(df: DataFrame, by: str, tie: Sequence[str], k: int) -> DataFrame:
    """The k largest rows; ``tie`` orders equals. Each task keeps only k rows."""
    return df.orderBy(F.desc(by), *tie).limit(k)


def first_k(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str | Column],
    k: int,
    rank: str = "rank",
) -> DataFrame:
    """First k rows per group, numbered from 1.

    The filter on the rank lets every task drop all but k rows of a group
    before the shuffle, so the size of a group does not matter.
    """
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def _least(rows: pa.Table, key: str, order_by: Sequence[str], k: int, total: str) -> pa.Table:
    """The first k rows of each key; the first of them carries the sum of the key's totals."""
    by = [(c, "ascending") for c in (key, *order_by)]
    rows = rows.take(pc.sort_indices(rows, sort_keys=by, null_placement="at_start"))
    codes = rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))
    totals = np.zeros(len(codes), np.int64)
    totals[starts] = np.add.reduceat(rows.column(total).to_numpy(), starts)
    # The field as it was: folded rows must fit the batches that follow them.
    rows = rows.set_column(rows.schema.get_field_index(total), rows.schema.field(total), pa.array(totals))
    return rows.filter(pa.array(place < k))


def _fold_least(
    batches: Iterator[pa.RecordBatch], key: str, order_by: Sequence[str], k: int, total: str
) -> Iterator[pa.RecordBatch]:
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([*kept, batch])
            kept = _least(rows, key, order_by, k, total).combine_chunks().to_batches()
    yield from kept


def first_k_and_count(
    rows: DataFrame, key: str, order_by: Sequence[str], k: int, rank: str = "rank", total: str = "total"
) -> DataFrame:
    """First k rows per key, numbered from 1, with the number of all rows of the key.

    One read: a task folds its batches to k rows a key, the first of which carries the
    count. These are folded again in ``SPREAD`` places a key, so the last window sees at
    most ``SPREAD`` times k rows of a key, however large it is.
    """
    counted = for_workers(rows).withColumn(total, F.lit(1).cast("bigint"))
    fold = partial(_fold_least, key=key, order_by=tuple(order_by), k=k, total=total)
    place = F.pmod(F.xxhash64(*order_by), F.lit(SPREAD))
    places = counted.mapInArrow(fold, counted.schema).repartition(F.col(key), place)
    least = places.mapInArrow(fold, counted.schema)
    group = Window.partitionBy(key)
    ranked = least.withColumns(
        {rank: F.row_number().over(group.orderBy(*order_by)), total: F.sum(total).over(group)}
    )
    return ranked.filter(F.col(rank) <= k)


def count_and_first(rows: DataFrame, key: str, count: str, value: str) -> DataFrame:
    """Rows per key and the value of the first row in order of arrival that has one.

    A row of one key goes to one of ``SPREAD`` places by its id; each place sends its
    count and first row on, so the rows are read once and a frequent key is spread.
    """
    spread = rows.withColumn("_place", F.pmod(F.xxhash64("event_id"), F.lit(SPREAD)))
    first = F.struct(F.col(value).isNull().alias("empty"), *ARRIVAL, F.col(value).alias("value"))
    places = spread.groupBy(key, "_place").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    return places.groupBy(key).agg(F.sum("n").alias(count), F.min("first")["value"].alias(value))


def global_rank(df: DataFrame, count: str, key: str, rank: str = "rank") -> DataFrame:
    """Numbers all rows by (count descending, key), without one sorting task.

    ``key`` is a hex digest, so its first three digits cut the rows of one
    count into 4096 even ranges. A row's number is the rows with a larger
    count, plus the earlier ranges of its own count, plus its place inside the
    range. The only unpartitioned window runs over the distinct counts, of
    which a log of N queries has at most sqrt(2N).
    """
    rows = df.withColumn("_range", F.substring(key, 1, 3))
    ranges = rows.groupBy(count, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    larger = Window.orderBy(F.desc(count)).rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        ranges.groupBy(count)
        .agg(F.sum("_rows").alias("_n"))
        .select(count, F.coalesce(F.sum("_n").over(larger), F.lit(0)).alias("_above"))
    )
    earlier = (
        Window.partitionBy(count).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = ranges.select(
        count, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    ).join(counts, count)
    place = F.row_number().over(Window.partitionBy(count, "_range").orderBy(key))
    return (
        rows.withColumn("_place", place)
        .join(offsets, [count, "_range"])
        .withColumn(rank, (F.col("_above") + F.col("_before") + F.col("_place")).cast("bigint"))
        .drop("_range", "_place", "_above", "_before")
    )


def with_share(df: DataFrame, count: str, name: str = "pct") -> DataFrame:
    """Adds the share of the total, which is one scalar subquery over ``df``."""
    from ..functions import share_pct

    total = df.agg(F.sum(count).alias("total"))
    return df.withColumn(name, share_pct(F.col(count), total.scalar()))


def last_n_days(days: DataFrame, n: int, day: str = "day") -> DataFrame:
    """The latest n days, oldest first."""
    return days.orderBy(F.desc(day)).limit(n).orderBy(day)


def top_k_and_other(df: DataFrame, key: str, count: str, k: int) -> DataFrame:
    """The k largest groups and one 'Other' row for the sum of the rest."""
    top = top_k(df, count, [key], k).select(key, F.lit(True).alias("_kept"))
    name = F.when(F.col("_kept"), F.col(key)).otherwise(F.lit("Other"))
    return (
        df.join(top, key, "left")
        .groupBy(name.alias(key))
        .agg(F.sum(count).alias(count))
    )
