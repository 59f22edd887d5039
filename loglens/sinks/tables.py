"""Summary sections and event tables as datasets under a dated path."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F


def dated_path(root: str, now: datetime | None = None) -> str:
    """<root>/exports/YYYY/MM/DD/usage-<time>."""
    now = now or datetime.now(timezone.utc)
    return f"{root.rstrip('/')}/exports/{now:%Y/%m/%d}/usage-{now:%Y%m%d-%H%M%S}"


def write_summary_tables(
    sections: Mapping[str, DataFrame], path: str, file_format: str = "parquet"
) -> None:
    """One dataset per section; sets are rows of their own section."""
    for name, table in sections.items():
        table.write.mode("overwrite").format(file_format).save(f"{path}/{name}")


def write_event_tables(
    events: DataFrame, path: str, file_format: str = "parquet", by: str = "event_time"
) -> None:
    """Events in one folder per day. The rebalance hint gathers each day's rows
    into files of even size and splits a day that is much larger than the rest."""
    dated = events.withColumn("event_date", F.to_date(by))
    (
        dated.hint("rebalance", F.col("event_date"))
        .write.mode("overwrite")
        .partitionBy("event_date")
        .format(file_format)
        .save(path)
    )


def write_summary_cells(cells: DataFrame, path: str) -> None:
    """Folded cells with a ``day`` column, a folder a day. Only the days at hand are replaced,
    so adding or mending a day reads the summaries of that day and no others."""
    (
        cells.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )
