"""Streaming jobs. Each runs over the files that have arrived and then stops
(``availableNow``), or for ever with another trigger.

Two shapes are used. Window counts keep state, bounded by a watermark, and
write the windows each batch changed. Keyed statistics keep no state: a batch
writes its partial rows under its own number, so a repeated batch replaces
itself, and the reader folds the partial rows, which keeps distinct users exact.
Deduplication and window counts have both shapes: those with a watermark drop what
comes later than it, ``first_copies`` with ``merge_copies`` and ``window_totals``
keep every row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.events import dedupe_events
from ..operators.facts import enrich_queries

DEFAULT_DELAY = "1 hour"


def read_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    file_format: str = "parquet",
    pattern: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Files as they arrive under a folder."""
    reader = spark.readStream.schema(schema).format(file_format)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _watermark(events: DataFrame, delay: str, column: str) -> DataFrame:
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def stream_dedupe(
    events: DataFrame,
    delay: str = DEFAULT_DELAY,
    key: str = "event_id",
    time: str = "event_time",
    salts: int = 8,
) -> DataFrame:
    """First row per id while the watermark still covers it; state is bounded.

    Rows without an id are kept: they skip the state. The copies of an id are
    first reduced in ``salts`` places, so that an id with very many copies does
    not pass whole through one task. That holds two states per id; ``salts=0``
    keeps one, for logs known to have few copies.
    """
    timed = _watermark(events, delay, time)
    has_id = F.coalesce(F.col(key), F.lit("")) != ""
    first = timed.filter(has_id)
    if salts > 1:
        salted = first.withColumn("_salt", F.floor(F.rand() * salts))
        first = salted.dropDuplicatesWithinWatermark([key, "_salt"]).drop("_salt")
    first = first.dropDuplicatesWithinWatermark([key])
    return first.unionByName(timed.filter(~has_id))


def stream_enrich(starts: DataFrame, stats: DataFrame) -> DataFrame:
    """Starts joined to a table of statistics, read anew for every batch; a start without
    statistics keeps its own text, workgroup and database, as in the batch join."""
    return enrich_queries(starts, stats)


def windowed_counts(
    events: DataFrame, width: str, delay: str = DEFAULT_DELAY, time: str = "event_time"
) -> DataFrame:
    """Events per tumbling window; later than the watermark is dropped."""
    rows = _watermark(events, delay, time)
    return (
        rows.groupBy(F.window(time, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("event_count"))
        .select(F.col("w.start").alias("window_start"), "event_count")
    )


def first_copies(batch: DataFrame) -> DataFrame:
    """The partial rows of a deduplicated stream: the first copy of each id of a batch."""
    return dedupe_events(batch)


def merge_copies(rows: DataFrame) -> DataFrame:
    """The first copy of each id over all batches, whatever their order: no state, no
    watermark, and no late row is lost."""
    return dedupe_events(rows)


def window_totals(events: DataFrame, width: str, time: str = "event_time") -> DataFrame:
    """Events per tumbling window of a merged table."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    counts = timed.groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("event_count"))
    return counts.select(F.col("w.start").alias("window_start"), "event_count")


def workgroup_cells(events: DataFrame) -> DataFrame:
    """Partial rows per (workgroup, user): they merge without losing users."""
    return events.groupBy("workgroup", "user_id").agg(
        F.count(F.lit(1)).alias("query_count"), F.sum("data_scanned").alias("data_scanned")
    )


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append rows to a Parquet folder."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )


def _batch_writer(path: str, transform: Callable[[DataFrame], DataFrame]):
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def append_partials(
    stream: DataFrame, partial: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Each batch writes ``partial(batch)`` under its number; no state is kept."""
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(_batch_writer(path, partial))
        .start()
    )


def write_windows(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch writes the windows it changed, with their new totals."""
    return (
        counts.writeStream.option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .foreachBatch(_batch_writer(path, lambda batch: batch))
        .start()
    )


def latest_windows(spark: SparkSession, path: str) -> DataFrame:
    """Window totals: the last one written, which is the largest."""
    rows = spark.read.parquet(path)
    return rows.groupBy("window_start").agg(F.max("event_count").alias("event_count"))


def merge_partials(
    spark: SparkSession, path: str, key: str, member: str, measures: Sequence[str]
) -> DataFrame:
    """Fold the partial rows of all batches to one row per key."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(
        *(F.sum(m).alias(m) for m in measures),
        F.countDistinct(member).alias("unique_members"),
    )
