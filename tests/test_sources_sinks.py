import csv
import glob
import gzip
import json
import os
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loglens import sinks, sources
from loglens.operators.events import Period
from loglens.operators.overview import (
    merge_export_summaries, merge_pattern_examples, merge_section, per_account_first_source, summary_example_tags, summary_queries,
)
from loglens.operators.querylog import query_log
from loglens.session import work_dir
from loglens.sources.audit_files import ORG_LAYOUT, read_org_audit_files
from loglens.sources.execution_stats import flatten_executions
from loglens import schemas


def write_audit(path, *ids, raw=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    body = raw if raw is not None else gzip.compress(
        json.dumps({"Records": [
            {"eventID": i, "eventName": "GetQueryExecution", "eventSource": "athena.amazonaws.com",
             "requestParameters": {"workGroup": "wg", "extra": [1, 2]}, "responseElements": None}
            for i in ids
        ]}).encode()
    )
    with open(path, "wb") as f:
        f.write(body)


PERIOD = Period.of("2024-01-01T12:00:00Z", "2024-01-02T01:00:00Z")


def test_audit_files_by_day(spark, folder):
    base = f"{folder}/AWSLogs/111111111111/CloudTrail/eu-west-1/2024/01"
    write_audit(f"{base}/01/a.json.gz", "1", "2")
    write_audit(f"{base}/02/b.json.gz", "3")
    write_audit(f"{base}/03/c.json.gz", "4")
    write_audit(f"{base}/02/broken.json.gz", raw=b"\x1f\x8bnot gzip")
    path = sources.audit_paths(folder, PERIOD, account="111111111111", region="eu-west-1")
    write_audit(f"{base}/02/cut.json", raw=b'{"Records":[{"eventID":"9"')
    write_audit(f"{base}/02/empty.json.gz")
    rows = sources.read_audit_files(spark, path).collect()
    assert sorted(r.eventID for r in rows) == ["1", "2", "3"]
    problems = {(os.path.basename(r.path), r.problem) for r in sources.audit_file_problems(spark, path).collect()}
    assert problems == {("broken.json.gz", "unreadable"), ("cut.json", "unreadable")}
    assert json.loads(rows[0].requestParameters) == {"workGroup": "wg", "extra": [1, 2]}


def test_large_files_are_skipped(spark, folder):
    write_audit(f"{folder}/small.json.gz", "1")
    write_audit(f"{folder}/big.json.gz", *(str(i * 7919 % 10**6) for i in range(500)))
    limit = os.path.getsize(f"{folder}/small.json.gz") + 10
    assert [r.eventID for r in sources.read_audit_files(spark, folder, max_bytes=limit).collect()] == ["1"]
    assert sources.read_audit_files(spark, folder).count() == 501
    problems = sources.audit_file_problems(spark, folder, limit).collect()
    assert [(os.path.basename(r.path), r.problem) for r in problems] == [("big.json.gz", "too large")]
    assert sources.audit_file_problems(spark, folder).collect() == []


def test_org_files_carry_their_account(spark, folder):
    for account in ("111111111111", "222222222222"):
        write_audit(f"{folder}/AWSLogs/o-1/{account}/CloudTrail/eu-west-1/2024/01/01/a.json.gz", account[:1])
    rows = read_org_audit_files(spark, folder, PERIOD, "o-1").collect()
    assert {(r.eventID, r.account_id) for r in rows} == {("1", "111111111111"), ("2", "222222222222")}
    assert read_org_audit_files(spark, folder, PERIOD, "") is None
    assert sources.audit_paths(folder, PERIOD, ORG_LAYOUT) is None


def summary(n, users, **extra):
    return {
        "configuration": {"analysis_mode": "multi"},
        "workgroup_stats": {"wg": {"query_count": n, "users": users, "total_data_scanned": 10 * n, "query_types": {"SELECT": n}}},
        "user_stats": {u: {"query_count": 1, "workgroups": ["wg"], "databases": []} for u in users},
        "database_stats": {"db": {"query_count": n, "users": users}},
        "query_patterns": {"abc": {"count": n, "examples": ["SELECT 1"], "users": users}},
        "s3_bucket_stats": {"b": {"get_count": n, "users": users}},
        "hourly_query_counts": {"2024-01-01T00": n},
        **extra,
    }


def write_bundle(path, **members):
    with zipfile.ZipFile(path, "w") as bundle:
        for name, value in members.items():
            bundle.writestr(name.replace("_json", ".json"), json.dumps(value))


@pytest.fixture(params=["whole", "indexed"])
def bundles(spark, folder, request):
    os.makedirs(f"{folder}/deep")
    event = {"event_id": "1", "event_time": "2024-01-01T00:00:00Z", "user_id": "ann", "status": "FAILED", "query": "SELECT 1", "data_scanned_in_bytes": 7}
    write_bundle(f"{folder}/a.zip", summary_json=summary(1, ["ann"]), athena_events_json=[event], s3_events_json=[{"bucket": "b", "additionalEventData": {"bytesTransferredIn": 3}}],
                 per_account_summary_json=[{"account_id": "1", "overview": {"total_athena_events": 1}}])
    write_bundle(f"{folder}/deep/b.zip", summary_json=summary(2, ["ann", "bob"], per_account=[{"account_id": "2", "error": "x"}]), athena_events_json=[event, event],
                 per_account_summary_json=[{"account_id": "2"}])
    write_bundle(f"{folder}/deep/c.zip", summary_json=summary(3, []))
    with open(f"{folder}/deep/broken.zip", "wb") as f:
        f.write(b"no zip")
    if request.param == "whole":
        return sources.read_export_bundles(sources.read_bundle_members(spark, folder))
    return sources.read_export_bundles(sources.read_indexed_members(sources.bundle_index(spark, folder)))


def test_bundles(bundles):
    assert bundles["summaries"].count() == 3
    log = query_log(bundles["athena_events"])
    row = log.first()
    assert log.count() == 3
    assert (row.query_string, row.data_scanned, row.event_time) == ("SELECT 1", 7, datetime(2024, 1, 1))
    assert bundles["s3_events"].first().extra_bytes_in == 3
    errors = bundles["errors"].collect()
    assert len(errors) == 1 and errors[0].error.startswith("Error processing") and "broken.zip" in errors[0].file
    rows = per_account_first_source(bundles["per_account"]).collect()
    assert sorted((r.source, r.account_id) for r in rows) == [("member", "1"), ("summary", "2")]


def test_merging_summaries(bundles):
    summaries = bundles["summaries"]
    group = merge_section(summaries, "workgroup").first()
    assert (group.query_count, group.total_data_scanned, group.unique_users) == (6, 60, 2)
    assert {r.name: r.query_count for r in merge_section(summaries, "user").collect()} == {"ann": 2, "bob": 1}
    assert merge_section(summaries, "bucket").first().get_count == 6
    rows = {(r.section, r.name, r.measure): r.value for r in merge_export_summaries(summaries).collect()}
    assert rows["query_type", "wg/SELECT", "query_count"] == 6 and rows["hour", "2024-01-01T00", "query_count"] == 6
    assert rows["pattern", "abc", "count"] == 6 and rows["pattern", "abc", "unique_users"] == 2
    assert rows["bucket", "b", "get_count"] == 6 and rows["user", "ann", "unique_workgroups"] == 1


def test_cells_of_days_are_replaced_and_folded_again(spark, tmp_path):
    from loglens.operators.overview import fold_cells, merge_cells, summary_cells
    from loglens.sinks import write_summary_cells

    def documents(*rows):
        raw = spark.createDataFrame([(d, json.dumps(x)) for d, x in rows], "day string, body string")
        return raw.select("day", F.from_json("body", schemas.SUMMARY).alias("s")).select("day", "s.*")

    def store(table):
        write_summary_cells(fold_cells(summary_cells(table, "day"), "day"), str(tmp_path / "cells"))

    def work(n, users, types):
        return {"workgroup_stats": {"w/x": {"query_count": n, "users": users, "query_types": types}, "none": {}}}

    first = ("2024-01-01", work(3, ["ann", "bob"], {"SELECT": 3}))
    store(documents(first, ("2024-01-02", work(9, ["wrong"], {"DROP": 9}))))
    second = ("2024-01-02", work(4, ["bob", "", None], {"SELECT": 1, "y": None}))
    store(documents(second))
    merged = merge_cells(spark.read.parquet(str(tmp_path / "cells")))
    got = {(r.section, r.name, r.measure): r.value for r in merged.collect()}
    assert got == {
        ("workgroup", "w/x", "query_count"): 7, ("workgroup", "w/x", "unique_users"): 3,
        ("workgroup", "none", "unique_users"): 0, ("query_type", "w/x/SELECT", "query_count"): 4,
    }
    whole = merge_export_summaries(documents(first, second, ("2024-01-03", {}), ("2024-01-03", {"workgroup_stats": {"none": None}})))
    assert {(r.section, r.name, r.measure): r.value for r in whole.collect()} == got


def test_examples_of_summaries(spark):
    def pattern(*examples, **more):
        return {"count": 4, "examples": list(examples), "users": ["bob", "ann"], "total_execution_time_ms": 8_000_000, **more}

    documents = [
        ("b", {"query_patterns": {"p": pattern("DROP TABLE t", "SELECT 1", "SELECT 2"), "q": {"count": 0, "examples": ["SELECT 3"]}}}),
        ("a", {"query_patterns": {"p": pattern("SELECT 2", "SELECT ST_Area(g) FROM t WHERE dt = 1")}}),
    ]
    raw = spark.createDataFrame([(f, json.dumps(d)) for f, d in documents], "file string, body string")
    summaries = raw.select("file", F.from_json("body", schemas.SUMMARY).alias("s")).select("file", "s.*")
    first = {(r.name, r.rank): r.example for r in merge_pattern_examples(summaries).collect()}
    assert first == {("p", 1): "SELECT 2", ("p", 2): "SELECT ST_Area(g) FROM t WHERE dt = 1", ("p", 3): "DROP TABLE t", ("q", 1): "SELECT 3"}
    queries = {r.query_string: (r.user_id, r.execution_time_ms) for r in summary_queries(summaries).collect()}
    assert queries["DROP TABLE t"] == ("bob", 2_000_000) and queries["SELECT 3"] == ("unknown", 0)
    tags = {(r.kind, r.tag): r.query_count for r in summary_example_tags(summaries).collect()}
    assert tags["ddl", "DROP"] == 1 and tags["flag", "GEOSPATIAL"] == 1 and tags["partition", "dt"] == 1
    assert tags["long_running", "over_30m"] == 5


def test_execution_stats(spark):
    lines = [
        {"QueryExecutionId": "a", "Query": "SELECT 1"},
        {"QueryExecutionId": "b", "Query": "SELECT 2", "WorkGroup": "wg", "QueryExecutionContext": {"Database": "d"},
         "Status": {"State": "RUNNING"}, "Statistics": {"DataScannedInBytes": 1, "EngineExecutionTimeInMillis": 5}},
        {"QueryExecutionId": "b", "Query": "SELECT 2", "WorkGroup": "wg", "QueryExecutionContext": {"Database": "d"},
         "Status": {"State": "SUCCEEDED"}, "Statistics": {"DataScannedInBytes": 9, "EngineExecutionTimeInMillis": 50}},
        {"QueryExecutionId": "", "Query": "SELECT 3"},
        {"QueryExecutionId": "c", "Query": ""},
    ]

    text = spark.createDataFrame([(json.dumps(x),) for x in lines], "t string")
    nested = text.select(F.from_json("t", schemas.EXECUTION).alias("x")).select("x.*")
    got = {tuple(r) for r in sources.read_execution_stats(flatten_executions(nested)).collect()}
    assert got == {
        ("a", "SELECT 1", "primary", "default", "", 0, 0),
        ("b", "SELECT 2", "wg", "d", "SUCCEEDED", 9, 50),
    }


STATS = "workgroup string, query_count bigint, unique_users bigint, total_data_scanned bigint"


def test_csv_quotes_names(spark, folder):
    stats = spark.createDataFrame([('=CMD("calc")', 3, 2, 2**30), ("wg", 1, 1, 0)], STATS).coalesce(1)
    sinks.write_workgroup_csv(stats, f"{folder}/csv")
    text = open(glob.glob(f"{folder}/csv/*.csv")[0]).read()
    assert '"=CMD(""calc"")"' in text
    rows = list(csv.reader(text.splitlines()))
    assert rows == [["workgroup", "query_count", "unique_users", "data_scanned_gb"], ['=CMD("calc")', "3", "2", "1.0000"], ["wg", "1", "1", "0.0000"]]
    guarded = sinks.csv_rows(stats, "'").first()
    assert guarded.workgroup.startswith("'=")


def test_lines(spark, folder):
    stats = spark.createDataFrame([("wg", 3, 2, 2**29)], STATS)
    types = spark.createDataFrame([("wg", {"DROP": 1, "SELECT": 2})], "workgroup string, query_types map<string,bigint>")
    line = sinks.workgroup_report_lines(stats, types).first().line.split("\n")
    assert line[:4] == ["Workgroup: wg", "  Queries: 3", "  Users: 2", "  Data Scanned: 0.50 GB"]
    assert line[4] in ("  Query Types: {'DROP': 1, 'SELECT': 2}", "  Query Types: {'SELECT': 2, 'DROP': 1}")
    overview = spark.createDataFrame([(5,)], "total_athena_events bigint")
    lines = sinks.metric_log_lines(overview, stats)
    sinks.write_lines(lines, f"{folder}/lines")
    got = [json.loads(r.value) for r in spark.read.text(f"{folder}/lines").collect()]
    assert {"type": "SUMMARY", "data": {"total_athena_events": 5}} in got
    assert {"type": "WORKGROUP", "workgroup": "wg", "query_count": 3, "unique_users": 2} in got


def test_tables(spark, folder):
    events = spark.createDataFrame([("1", datetime(2024, 1, 1, 5)), ("2", datetime(2024, 1, 2))], "event_id string, event_time timestamp")
    sinks.write_event_tables(events, f"{folder}/events")
    assert os.path.isdir(f"{folder}/events/event_date=2024-01-01")
    assert spark.read.parquet(f"{folder}/events").count() == 2
    path = sinks.dated_path(folder, datetime(2024, 3, 4, 5, 6, 7))
    assert path == f"{folder}/exports/2024/03/04/usage-20240304-050607"
    sinks.write_summary_tables({"events": events}, path, "json")
    assert spark.read.json(f"{path}/events").count() == 2


def test_work_dir_is_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = work_dir(spark, "x")
    assert path != work_dir(spark, "x")
    if base:
        assert path.startswith(base.rstrip("/"))


def test_broken_member_gives_an_error_and_no_event(spark, folder):
    write_bundle(f"{folder}/a.zip", summary_json=summary(1, ["ann"]))
    with zipfile.ZipFile(f"{folder}/b.zip", "w") as bundle:
        bundle.writestr("athena_events.json", '[{"event_id": "1"}')
    tables = sources.read_export_bundles(sources.read_indexed_members(sources.bundle_index(spark, folder)))
    assert tables["athena_events"].count() == 0 and tables["summaries"].count() == 1
    assert [r.file[-5:] for r in tables["errors"].collect()] == ["b.zip"]
