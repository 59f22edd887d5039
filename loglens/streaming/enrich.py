"""Starts and statistics joined while both arrive.

Statistics come some time after the start of their query. The join holds starts until the
watermark is past their horizon: with statistics they come out at once, without any they
come out once, as they are. Statistics later than the horizon are not lost: the stream of
statistics is also logged, and ``corrected`` gives unmatched starts what came later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.facts import STATS, enrich_queries, prefer_stats
from .jobs import DEFAULT_DELAY


def enrich_arriving(
    starts: DataFrame,
    stats: DataFrame,
    horizon: str = "1 day",
    delay: str = DEFAULT_DELAY,
    time: str = "event_time",
    stats_time: str = "stats_time",
) -> DataFrame:
    """A stream of facts, with ``found``: starts joined to the statistics whose time is at most
    ``horizon`` after them. Both streams hold one row per execution id. State is bounded by the
    horizon and the delay that each stream's rows may have."""
    left = starts.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    right = stats.select(
        F.col("query_execution_id").alias("stats_id"), F.col(stats_time).cast("timestamp").alias("stats_time"), F.struct(*STATS).alias("stats")
    ).withWatermark("stats_time", delay)
    near = F.col("stats_time").between(F.col(time), F.col(time) + F.expr(f"INTERVAL {horizon}"))
    joined = left.join(right, (F.col("query_execution_id") == F.col("stats_id")) & near, "left_outer")
    return prefer_stats(joined.withColumn("found", F.col("stats").isNotNull()), "found")


def corrected(facts: DataFrame, stats: DataFrame) -> DataFrame:
    """Facts of ``enrich_arriving`` where starts without statistics get those of the log; only
    these few meet it. Without ``found``, as the batch join gives them."""
    columns = [c for c in facts.columns if c != "found"]
    open_starts = facts.filter(~F.col("found")).withColumn("query_string", F.col("query"))
    later = enrich_queries(open_starts.drop("query", "status", "data_scanned", "execution_time_ms"), stats)
    return facts.filter("found").select(*columns).unionByName(later.select(*columns))
