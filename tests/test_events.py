import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loglens.operators import accounts as ac, events as ev, facts as fc
from loglens.plans.collector import collect_usage, land_records, summary_sections
from loglens import schemas


def record(event_id="e1", name="StartQueryExecution", source="athena.amazonaws.com", **extra):
    base = {
        "eventID": event_id,
        "eventName": name,
        "eventSource": source,
        "eventTime": "2024-01-02T03:04:05Z",
        "userIdentity": {"arn": "arn:aws:iam::1:user/ann", "principalId": "P"},
        "requestParameters": {"workGroup": "wg", "queryString": "SELECT 1", "queryExecutionContext": {"database": "db"}},
        "responseElements": {"queryExecutionId": "q-" + event_id},
    }
    return {**base, **extra}


def frame(spark, *records):
    lines = []
    for r in records:
        r = dict(r)
        for name in ("requestParameters", "responseElements", "additionalEventData"):
            if r.get(name) is not None:
                r[name] = json.dumps(r[name])
        lines.append((json.dumps(r),))
    return (
        spark.createDataFrame(lines, "t string")
        .select(F.from_json("t", schemas.RECORD).alias("r"))
        .select("r.*")
    )


def test_wrapped_and_plain_records_agree(spark):
    rows = spark.createDataFrame(
        [(json.dumps(record("a")), None), (None, "b")], "CloudTrailEvent string, eventID string"
    )
    got = ev.unwrap_api_record(rows)
    assert sorted(r.eventID for r in got.collect()) == ["a", "b"]
    assert got.columns == schemas.RECORD.fieldNames()


def test_broken_wrapped_record_is_dropped_by_routing(spark):
    rows = spark.createDataFrame([("{not json",)], "CloudTrailEvent string")
    assert ev.route_events(ev.unwrap_api_record(rows)).count() == 0


def test_routing(spark):
    cases = [
        record("1"),
        record("2", "GetDatabase", "glue.amazonaws.com"),
        record("3", "GetObject", "s3.amazonaws.com"),
        record("4", "DeleteObject", "s3.amazonaws.com"),
        record("5", "ConsoleLogin", "signin.amazonaws.com"),
        record("6", "Anything", "athena.amazonaws.com"),
    ]
    rows = frame(spark, *cases)
    got = {r.eventID: r.route for r in ev.route_events(rows).collect()}
    assert got == {"1": "query", "2": "query", "3": "store", "6": "query"}
    strict = {r.eventID for r in ev.route_events(rows, strict_source=True).collect()}
    assert strict == {"1", "3", "6"}


def test_dedupe_keeps_first_and_all_without_id(spark):
    rows = spark.createDataFrame(
        [("a", 2, "late"), ("a", 1, "early"), ("", 1, "x"), ("", 1, "x"), (None, 1, "y"), ("b", 1, "z")],
        "event_id string, event_time int, v string",
    )
    got = sorted(r.v for r in ev.dedupe_events(rows).collect())
    assert got == ["early", "x", "x", "y", "z"]


def test_dedupe_drops_copies_before_the_shuffle(spark):
    """An id with very many copies sends one row per task."""
    hot = spark.range(0, 40_000, 1, 4).select(
        F.concat(F.lit("same"), (F.col("id") % 1).cast("string")).alias("event_id"),
        F.col("id").alias("event_time"),
    )
    deduped = ev.dedupe_events(hot)
    plan = deduped._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan and "row_number(), 1, Final" in plan
    assert [r.event_time for r in deduped.collect()] == [0]


def test_normalised_query_event(spark):
    row = ev.normalize_athena_events(
        frame(spark, record("1", requestParameters=None, responseElements=None, userIdentity={"principalId": "P"}))
    ).first()
    assert (row.workgroup, row.database, row.user_id, row.user_arn) == ("primary", "default", "P", "unknown")
    assert (row.request_parameters, row.response_elements, row.aws_region) == ("{}", "{}", "")
    full = ev.normalize_athena_events(frame(spark, record("1"))).first()
    assert (full.workgroup, full.database, full.query_execution_id) == ("wg", "db", "q-1")
    assert json.loads(full.request_parameters)["queryString"] == "SELECT 1"


def test_workgroup_and_bucket_filters(spark):
    groups = spark.createDataFrame([("a",), ("A",), (None,)], "workgroup string")
    assert ev.workgroup_allow_list(groups).count() == 3
    assert [r.workgroup for r in ev.workgroup_allow_list(groups, {"a"}).collect()] == ["a"]
    assert {r.workgroup for r in ev.skipped_workgroups(groups, {"a"}).collect()} == {"A", "primary"}
    buckets = spark.createDataFrame([("My-DataLake",), ("misc",), ("",), (None,)], "bucket string")
    assert [r.bucket for r in ev.bucket_filter(buckets).collect()] == ["My-DataLake"]
    assert [r.bucket for r in ev.bucket_filter(buckets, {"misc"}).collect()] == ["misc"]
    assert [r.bucket for r in ev.skipped_buckets(buckets).collect()] == ["misc"]


def test_period_checks():
    with pytest.raises(ValueError, match="ISO"):
        ev.Period.of("yesterday", "2024-01-02")
    with pytest.raises(ValueError, match="90 days"):
        ev.Period.of("2024-01-01T00:00:00Z", "2024-06-01T00:00:00Z", max_days=90)
    assert len(ev.Period.of("2024-01-01T00:00:00Z", "2024-06-01T00:00:00Z").days()) == 153
    with pytest.raises(ValueError, match="before"):
        ev.Period.of("2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z")
    now = datetime(2024, 5, 1, tzinfo=timezone.utc)
    assert (now - ev.Period.last_days(now=now).start).days == 90
    assert (now - ev.Period.last_minutes(now=now).start).seconds == 3600
    # The last day is read even when the period starts late in the first day.
    days = ev.Period.of("2024-01-01T23:00:00Z", "2024-01-03T01:00:00Z").days()
    assert [d.day for d in days] == [1, 2, 3]


def test_time_filter_reaches_the_scan(spark, folder):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 86_400).alias("event_time"))
    rows.write.parquet(f"{folder}/t")
    period = ev.Period.of("1970-01-05T00:00:00Z", "1970-01-08T00:00:00Z")
    got = ev.time_range_filter(spark.read.parquet(f"{folder}/t"), period)
    assert got.count() == 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_time), GreaterThanOrEqual(event_time" in plan


STATS = "query_execution_id string, query string, workgroup string, database string, status string, data_scanned bigint, execution_time_ms bigint"


def test_enrichment(spark):
    records = frame(
        spark,
        record("1"),
        record("1"),
        record("2", requestParameters={"workGroup": "wg"}),
        record("3", requestParameters={"workGroup": "wg"}),
        record("4", responseElements=None),
    )
    stats = spark.createDataFrame(
        [
            ("q-1", "SELECT 2", "other", "db2", "SUCCEEDED", 10, 20),
            ("q-3", "SELECT 3", "primary", "default", "FAILED", 0, 0),
            ("q-9", "SELECT 9", "wg", "db", "SUCCEEDED", 1, 1),
        ],
        STATS,
    )
    run = collect_usage(records, stats)
    assert run.starts.count() == 3
    got = {r.query_execution_id: r for r in run.enriched.collect()}
    assert (got["q-1"].query, got["q-1"].workgroup, got["q-1"].data_scanned) == ("SELECT 2", "other", 10)
    assert got["q-2"].query is None
    assert {r.query_execution_id for r in run.facts.collect()} == {"q-1", "q-3"}
    assert [r.query_execution_id for r in fc.stats_without_start(stats, run.starts).collect()] == ["q-9"]
    bare = collect_usage(records)
    row = bare.facts.first()
    assert (row.query, row.status, row.data_scanned, row.execution_time_ms) == ("SELECT 1", "", 0, 0)


def test_last_start_first_text(spark):
    a = record("1", eventTime="2024-01-01T00:00:00Z", responseElements={"queryExecutionId": "q"})
    b = record(
        "2",
        eventTime="2024-01-02T00:00:00Z",
        responseElements={"queryExecutionId": "q"},
        userIdentity={"arn": "arn:aws:iam::1:user/bob"},
        requestParameters={"queryString": "SELECT 2"},
    )
    row = collect_usage(frame(spark, b, a)).facts.first()
    assert (row.user_id, row.query, row.workgroup) == ("bob", "SELECT 1", "wg")


def test_polls_count_once(spark):
    def poll(i, size):
        run = {"queryExecutionId": "q", "workGroup": "wg", "statistics": {"dataScannedInBytes": size}}
        return record(f"p{i}", "GetQueryExecution", responseElements={"queryExecution": run})

    events = collect_usage(frame(spark, poll(1, 5), poll(2, 9), poll(3, 9))).events
    assert [tuple(r) for r in fc.polled_data_scanned(events).collect()] == [("wg", 9)]


def test_landed_and_stored_runs_equal_the_lazy_one(spark, folder):
    records = frame(
        spark,
        record("1"),
        record("1"),
        record("2", "GetObject", "s3.amazonaws.com", requestParameters={"bucketName": "raw-x", "key": "a/b/c"}),
        record("3", "PutObject", "s3.amazonaws.com", requestParameters={"bucketName": "misc", "key": "a"}),
        record("4", "ConsoleLogin", "signin.amazonaws.com"),
    )
    lazy = collect_usage(records)
    landed = collect_usage(land_records(records, f"{folder}/land"))
    stored = landed.stored(f"{folder}/run")

    def content(run):
        tables = summary_sections(run)
        return {n: sorted(map(str, (tuple(sorted(r.asDict().items())) for r in t.collect()))) for n, t in tables.items()}

    want = content(lazy)
    assert content(landed) == want and content(stored) == want
    assert lazy.store_events.count() == 1


def test_summary_tells_period_settings_and_errors(spark, folder):
    from loglens import sinks

    records = frame(spark, record("1"), record("2", eventTime="2024-01-02T10:00:00Z"))
    period = ev.Period.of("2024-01-01T00:00:00Z", "2024-01-03T23:00:00Z")
    errors = spark.createDataFrame([("b/x.gz", 3, "cut off")], "path string, size bigint, problem string")
    run = collect_usage(records, workgroups=("primary", "etl"), period=period).stored(f"{folder}/run")
    sinks.write_summary_tables(summary_sections(run, errors, {"analysis_mode": "batch"}), f"{folder}/out")

    def read(name):
        return sorted(tuple(map(str, r)) for r in spark.read.parquet(f"{folder}/out/{name}").collect())

    assert read("analysis_period") == [("2024-01-01 00:00:00", "2024-01-03 23:00:00")]
    assert read("configuration") == [
        ("analysis_mode", "batch"),
        ("monitored_s3_buckets", "*"),
        ("monitored_workgroups", "etl"),
        ("monitored_workgroups", "primary"),
    ]
    assert read("errors") == [("b/x.gz", "cut off")]
    bare = summary_sections(collect_usage(records))
    assert [tuple(r) for r in bare["analysis_period"].collect()] == [(None, None)]
    assert bare["errors"].count() == 0


def test_landed_period_opens_only_its_days(spark, folder):
    records = frame(
        spark,
        *(record(str(d), eventTime=f"2024-01-0{d}T10:00:00Z") for d in range(1, 6)),
        record("bad", eventTime="nope"),
    )
    period = ev.Period.of("2024-01-02T00:00:00Z", "2024-01-03T23:00:00Z")
    landed = land_records(records, f"{folder}/land")
    run = collect_usage(landed, period=period)
    assert sorted(r.event_id for r in run.events.collect()) == ["2", "3"]
    assert sorted(r.event_id for r in collect_usage(records, period=period).events.collect()) == ["2", "3"]
    plan = run.events._jdf.queryExecution().optimizedPlan().toString()
    assert "event_date" in plan and collect_usage(landed).events.count() == 6


def test_accounts(spark):
    rows = spark.createDataFrame(
        [("1", "ACTIVE"), ("2", "SUSPENDED"), ("3", "ACTIVE")], "account_id string, status string"
    )
    assert [r.account_id for r in ac.active_member_accounts(rows, "1").collect()] == ["3"]
    lists = spark.createDataFrame(
        [("111111111111, 222222222222 ,,12x\n# 333333333333\n\n 444444444444 ",)], "text string"
    )
    got = {r.account_id: r.valid for r in ac.valid_account_ids(lists, "222222222222").collect()}
    assert got == {"111111111111": True, "12x": False, "444444444444": True}


def test_coverage_and_outcome(spark):
    accounts = spark.createDataFrame([("1",), ("2",), ("3",)], "account_id string")
    counts = spark.createDataFrame([("1", 5)], "account_id string, total_athena_events bigint")
    errors = spark.createDataFrame([("2", "no role")], "account_id string, error string")
    rows = ac.account_coverage(accounts, counts, errors)
    assert {r.account_id: (r.total_athena_events, r.status) for r in rows.collect()} == {
        "1": (5, "OK"), "2": (0, "no role"), "3": (0, "No events"),
    }
    assert tuple(ac.run_outcome(rows).first()) == (3, 2, 1)
    assert [tuple(r) for r in ac.run_errors(rows).collect()] == [("2", "no role")]


def test_the_kept_copy_does_not_depend_on_partitions(spark):
    rows = [(f"e{i % 5}", "2024-01-01T00:00:00", f"payload {i}") for i in range(64)] + [("", "t", "same")] * 3 + [(None, "t", "x")]
    df = spark.createDataFrame(rows, "event_id string, event_time string, payload string")
    kept = [sorted(map(str, ev.dedupe_events(df.repartition(n)).collect())) for n in (1, 3, 16)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 5 + 4


def test_period_does_not_depend_on_the_session_zone(spark):
    period = ev.Period.of("2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z")
    times = [(f"2024-01-0{d}T{h:02}:30:00Z",) for d in (1, 2) for h in (0, 5, 23)]
    try:
        found = []
        for zone in ("America/Los_Angeles", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            rows = spark.createDataFrame(times, "t string")
            for kind in ("timestamp", "timestamp_ntz"):
                column = F.col("t").cast("timestamp") if kind == "timestamp" else F.to_timestamp_ntz(F.regexp_replace("t", "Z", ""))
                found.append(ev.time_range_filter(rows.select(column.alias("event_time")), period).count())
        assert found == [3, 3, 3, 3]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_unreadable_wrapped_records_are_listed(spark):
    rows = spark.createDataFrame([('{"eventID": "1"}',), ('{"eventID": "2"',), ("no json",), (None,)], "CloudTrailEvent string")
    assert sorted(r[0] for r in ev.unreadable_api_records(rows).collect()) == ["no json", '{"eventID": "2"']


def test_records_are_gathered_before_their_json_is_parsed(spark, folder):
    from loglens.plans import collector

    days = [record(str(n), eventTime=f"2024-01-{n:02d}T00:00:00Z", requestParameters={"queryString": f"SELECT {n}"}) for n in range(1, 32)]
    odd = [record("x", eventTime="not-a-time", requestParameters={}), record("y", eventTime="2024-02-01T00:00:00Z", requestParameters=None)]
    records = frame(spark, *days, *odd).coalesce(1)
    flat, _ = collector._gathered(records, False, True)
    later, earlier = flat._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)
    assert "AS _req" in later and "AS _req" not in earlier
    assert len(days) > collector.OPEN_FOLDERS
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    landed = land_records(records, f"{folder}/land")
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    want = ev.normalize_events(ev.route_events(records)).collect()
    assert sorted(map(str, landed.drop("event_date").select(*flat.drop("event_date").columns).collect())) == sorted(map(str, want))
    got = {r.event_id: (str(r.event_date), r.query_string) for r in landed.collect()}
    assert got["7"] == ("2024-01-07", "SELECT 7") and got["x"] == ("None", None) and got["y"] == ("2024-02-01", None)


def test_stored_facts_keep_what_reports_read_from_their_text(spark, folder):
    from loglens.operators import overview, usage

    run = collect_usage(frame(spark, record("1"))).stored(f"{folder}/run")
    reports = [usage.query_patterns(run.facts), usage.database_stats(run.facts), overview.account_rollup(run.facts, run.events, run.store_events)]
    for report in reports[:2]:
        assert "regexp" not in report._jdf.queryExecution().optimizedPlan().toString()
    lazy = collect_usage(frame(spark, record("1")))
    again = [usage.query_patterns(lazy.facts), usage.database_stats(lazy.facts), overview.account_rollup(lazy.facts, lazy.events, lazy.store_events)]
    for report, other in zip(reports, again):
        assert sorted(map(str, report.collect())) == sorted(map(str, other.collect()))
    assert "regexp" in again[0]._jdf.queryExecution().optimizedPlan().toString()
