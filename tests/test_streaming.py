"""Streams give the batch result, over several batches and after a repeat."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loglens import streaming as st

SCHEMA = "event_id string, event_time timestamp, user_id string, workgroup string, data_scanned bigint"
START = datetime(2024, 1, 1)


def write_files(spark, path, *files):
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def row(i, minutes, user="ann", group="wg"):
    return (str(i) if i else "", START + timedelta(minutes=minutes), user, group, 1)


def stream(spark, path, **options):
    return st.read_stream(spark, path, spark.read.parquet(path).schema, **options)


def test_dedupe_across_batches(spark, folder):
    path = f"{folder}/in"
    write_files(spark, path, [row(1, 0), row(1, 0), row(0, 1), row(0, 1)], [row(1, 0), row(2, 5)])
    deduped = st.stream_dedupe(stream(spark, path, files_per_batch=1))
    st.run_to_files(deduped, f"{folder}/out", f"{folder}/cp").awaitTermination()
    got = sorted(r.event_id for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == ["", "", "1", "2"]


@pytest.mark.parametrize("salts", [0, 8])
def test_dedupe_of_very_many_copies(spark, folder, salts):
    path = f"{folder}/in"
    write_files(spark, path, [row(1, 0)] * 300 + [row(2, 1)], [row(1, 0)] * 50 + [row(0, 2), row(3, 2)])
    deduped = st.stream_dedupe(stream(spark, path, files_per_batch=1), salts=salts)
    st.run_to_files(deduped, f"{folder}/out", f"{folder}/cp").awaitTermination()
    got = sorted(r.event_id for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == ["", "1", "2", "3"]


def test_windows_over_batches(spark, folder):
    path = f"{folder}/in"
    write_files(spark, path, [row(1, 0), row(2, 59), row(3, 61)], [row(4, 30), row(5, 62)])
    counts = st.windowed_counts(stream(spark, path, files_per_batch=1), "1 hour")
    st.write_windows(counts, f"{folder}/out", f"{folder}/cp").awaitTermination()
    got = st.latest_windows(spark, f"{folder}/out").orderBy("window_start").collect()
    assert [r.event_count for r in got] == [3, 2]


def test_late_events_are_dropped_past_the_watermark(spark, folder):
    path = f"{folder}/in"
    write_files(spark, path, [row(1, 0), row(2, 600)])
    run = lambda: st.write_windows(
        st.windowed_counts(stream(spark, path), "1 hour"), f"{folder}/out", f"{folder}/cp"
    ).awaitTermination()
    run()
    write_files(spark, path, [row(3, 1), row(4, 601)])
    run()
    got = {r.window_start: r.event_count for r in st.latest_windows(spark, f"{folder}/out").collect()}
    assert got == {START: 1, START + timedelta(hours=10): 2}


def test_partials_keep_distinct_users_exact(spark, folder):
    path = f"{folder}/in"
    write_files(spark, path, [row(1, 0), row(2, 1, "bob")], [row(3, 2), row(4, 3, "eve", "etl")])
    out, cp = f"{folder}/out", f"{folder}/cp"
    st.append_partials(stream(spark, path, files_per_batch=1), st.workgroup_cells, out, cp).awaitTermination()
    st.append_partials(stream(spark, path, files_per_batch=1), st.workgroup_cells, out, cp).awaitTermination()
    merged = st.merge_partials(spark, out, "workgroup", "user_id", ["query_count", "data_scanned"])
    assert {tuple(r) for r in merged.collect()} == {("wg", 3, 3, 2), ("etl", 1, 1, 1)}


def test_enrich(spark, folder):
    path = f"{folder}/in"
    write_files(spark, path, [row(1, 0), row(2, 1)])
    stats = spark.createDataFrame(
        [("1", "SELECT 1", "s", "d", "OK", 5, 7)],
        "query_execution_id string, query string, workgroup string, database string, status string, data_scanned long, execution_time_ms long",
    )
    starts = stream(spark, path).withColumns(
        {"query_execution_id": F.col("event_id"), "account_id": F.lit("a"), "query_string": F.lit("own"), "database": F.lit("own_db")}
    )
    st.run_to_files(st.stream_enrich(starts, stats), f"{folder}/out", f"{folder}/cp").awaitTermination()
    got = {(r.event_id, r.query, r.workgroup, r.database, r.status, r.data_scanned) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {("1", "SELECT 1", "s", "d", "OK", 5), ("2", "own", "wg", "own_db", "", 0)}


def test_no_row_is_lost_in_any_order_of_batches(spark, folder):
    path = f"{folder}/in"
    write_files(spark, path, [row(1, 6000), row(2, 6001)], [row(3, 1), row(1, 6000), row(0, 2)], [row(4, 3000), row(0, 2), row(3, 1)])
    st.append_partials(stream(spark, path, files_per_batch=1), st.first_copies, f"{folder}/out", f"{folder}/cp").awaitTermination()
    merged = st.merge_copies(spark.read.parquet(f"{folder}/out").drop("batch"))
    assert sorted(r.event_id for r in merged.collect()) == ["", "", "1", "2", "3", "4"]
    assert sorted(r.event_count for r in st.window_totals(merged, "1 hour").collect()) == [1, 2, 3]


STATS = "query_execution_id string, query string, workgroup string, database string, status string, data_scanned long, execution_time_ms long, stats_time timestamp"


def statistics(i, minutes):
    return (f"q{i}", "SELECT 1", "s", "d", "OK", 5, 7, START + timedelta(minutes=minutes))


def test_statistics_that_arrive_after_the_start(spark, folder):
    schema = SCHEMA + ", query_execution_id string, account_id string, query_string string, database string"
    full = lambda i, minutes: (*row(i, minutes), f"q{i}", "a", "own", "own_db")
    for files, kind, name in (
        ([[full(1, 0), full(2, 1), full(3, 2), full(4, 3)], [full(5, 600)], [full(9, 100000)]], schema, "starts"),
        ([[statistics(1, 5)], [statistics(2, 30), statistics(5, 610)], [statistics(3, 3000), statistics(8, 100000)]], STATS, "stats"),
    ):
        for rows in files:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    facts = st.enrich_arriving(
        stream(spark, f"{folder}/starts", files_per_batch=1), stream(spark, f"{folder}/stats", files_per_batch=1), horizon="2 hours"
    )
    st.run_to_files(facts, f"{folder}/out", f"{folder}/cp").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    assert sorted((r.event_id, r.found) for r in out.collect()) == [("1", True), ("2", True), ("3", False), ("4", False), ("5", True)]
    whole = st.corrected(out, spark.read.parquet(f"{folder}/stats"))
    got = sorted((r.event_id, r.query, r.status) for r in whole.collect())
    assert got == [("1", "SELECT 1", "OK"), ("2", "SELECT 1", "OK"), ("3", "SELECT 1", "OK"), ("4", "own", ""), ("5", "SELECT 1", "OK")]
