"""Batches merged into folders: equal to the batch result, only touched folders rewritten."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loglens import streaming as st
from loglens.operators.events import dedupe_events
from loglens.streaming.merged import MergedTable, cells_by, counts_by

SCHEMA = "event_id string, event_time timestamp, user_id string, workgroup string, data_scanned long"
START = datetime(2024, 1, 1)
SUMMARIES = {"hours": counts_by("1 hour"), "groups": cells_by(["workgroup", "user_id"], {"data_scanned": "data_scanned"})}


def some_rows(rng, n, days=6):
    out = []
    for _ in range(n):
        k = rng.randint(0, 60)
        time = START + timedelta(minutes=rng.randint(0, days * 1440)) if rng.random() < 0.3 else START + timedelta(hours=k * 2)
        out.append((f"e{k}" if rng.random() < 0.9 else rng.choice(["", None]), time if rng.random() < 0.95 else None, rng.choice("abc"), rng.choice(["x", "y"]), rng.randint(0, 9)))
    return out


def table(spark, folder, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    return MergedTable(spark, f"{folder}/merged", schema, SUMMARIES, **options)


def rows_of(df):
    return sorted(map(str, df.collect()))


def versions(merged):
    return {folder: v for folder, v in merged.manifest().items()}


@pytest.mark.parametrize("bits", [4, 20])
def test_equals_the_batch_result_in_any_order(spark, folder, bits):
    rng = random.Random(bits)
    batches = [some_rows(rng, n) for n in (40, 1, 60, 25)]
    merged = table(spark, folder, buckets=3, bits=bits)
    for k, rows in enumerate(batches):
        merged.apply(spark.createDataFrame(rows, SCHEMA), k)
        whole = dedupe_events(spark.createDataFrame([r for b in batches[: k + 1] for r in b], SCHEMA))
        assert rows_of(merged.rows()) == rows_of(whole)
    hours = merged.summary("hours").groupBy("window_start").agg(F.sum("event_count").alias("n"))
    want = whole.filter("event_time IS NOT NULL").groupBy(F.date_trunc("hour", "event_time").alias("window_start")).agg(F.count("*").alias("n"))
    assert rows_of(hours) == rows_of(want)
    groups = merged.summary("groups").groupBy("workgroup").agg(F.sum("query_count").alias("n"), F.sum("data_scanned").alias("s"), F.countDistinct("user_id").alias("u"))
    assert rows_of(groups) == rows_of(whole.groupBy("workgroup").agg(F.count("*").alias("n"), F.sum("data_scanned").alias("s"), F.countDistinct("user_id").alias("u")))


def test_only_touched_folders_are_rewritten_and_a_replay_changes_nothing(spark, folder):
    merged = table(spark, folder, buckets=2)
    first = [(f"e{k}", START + timedelta(days=k % 4), "a", "x", 1) for k in range(40)]
    merged.apply(spark.createDataFrame(first, SCHEMA), 0)
    second = spark.createDataFrame([("new", START, "a", "x", 1), ("e0", START, "a", "x", 1)], SCHEMA)
    merged.apply(second, 1)
    moved = {f for f, v in versions(merged).items() if v == 1}
    assert moved and all(day == "2024-01-01" for day, _ in moved) and len(versions(merged)) == 8
    before, kept = rows_of(merged.rows()), versions(merged)
    merged.apply(second, 1)
    assert rows_of(merged.rows()) == before and versions(merged) == kept and len(before) == 41
    # A batch that died before its manifest leaves no trace.
    merged.apply(spark.createDataFrame([("late", START, "b", "y", 1)], SCHEMA), 2)
    os.rename(f"{folder}/merged/manifest/batch=2", f"{folder}/lost")
    assert rows_of(merged.rows()) == before


def test_copies_on_another_day(spark, folder):
    merged = table(spark, folder, buckets=2)
    merged.apply(spark.createDataFrame([("a", START + timedelta(days=3), "late", "x", 1), ("b", START, "first", "x", 1)], SCHEMA), 0)
    merged.apply(spark.createDataFrame([("a", START, "first", "x", 1), ("b", START + timedelta(days=2), "late", "x", 1)], SCHEMA), 1)
    assert sorted((r.event_id, r.user_id) for r in merged.rows().collect()) == [("a", "first"), ("b", "first")]
    assert {day for day, _ in versions(merged)} == {"2024-01-01"}  # the folder that lost its row is gone


def test_stream_of_files(spark, folder):
    rng = random.Random(5)
    batches = [some_rows(rng, 20) for _ in range(3)]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    arriving = st.read_stream(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    merged = table(spark, folder)
    assert merged.rows().collect() == []
    merged.follow(arriving, f"{folder}/cp").awaitTermination()
    merged.follow(arriving, f"{folder}/cp").awaitTermination()
    whole = dedupe_events(spark.createDataFrame([r for b in batches for r in b], SCHEMA))
    assert rows_of(merged.rows()) == rows_of(whole)


def test_a_batch_is_dealt_before_it_is_sorted(spark, folder):
    """One large file is read by one task; what that task sorts grew with the file."""
    rows = spark.range(2000, numPartitions=1).select(
        F.when(F.col("id") % 9 > 0, F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("e"), F.col("id") % 300))).alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.pmod(F.xxhash64("id"), F.lit(60)).cast("int"))).alias("event_time"),
        F.col("id"),
    )
    rows.coalesce(1).write.parquet(f"{folder}/in")
    rows = spark.read.parquet(f"{folder}/in")
    want = sorted(dedupe_events(rows).collect(), key=str)
    assert all(sorted(dedupe_events(rows, places=n).collect(), key=str) == want for n in (1, 8))
    plans = []
    write = MergedTable._placed

    class Watched(MergedTable):
        def _placed(self, rows):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
            return write(self, rows)

    Watched(spark, f"{folder}/merged", rows.schema, buckets=1).apply(rows, 0)
    lines = plans[0].split("Union")[1].splitlines()
    depth = [line for line in lines if "Sort [" in line or "Exchange" in line or "FileScan" in line]
    first_scan = next(i for i, line in enumerate(depth) if "FileScan" in line)
    assert "Exchange" in depth[first_scan - 1]


def test_a_larger_log_arrives_in_more_files(spark, monkeypatch):
    import glob

    from checks import queries

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(queries, "FILE_ROWS", 200)
    merged = queries._merged_stream(spark, sf, "more-files")
    n = queries.usage(spark, sf).count()
    root = merged.root.rsplit("/", 1)[0]
    assert len(glob.glob(f"{root}/arriving/*.parquet")) == 2 * (1 + (n - 1) // 400) > 2
    assert len(glob.glob(f"{root}/merged/manifest/batch=*")) == 2
