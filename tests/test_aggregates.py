"""Aggregates and ranked tables against brute force on small fixtures."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from loglens.operators import members as mb, overview as ov, querylog as ql, ranking as rk, store as so, usage as us

FACTS = "query_execution_id string, event_time timestamp, event_id string, user_id string, account_id string, query string, workgroup string, database string, status string, data_scanned bigint, execution_time_ms bigint"


def fact(i, user, query, workgroup="wg", database="db", account="1", size=1, ms=10):
    from datetime import datetime, timedelta

    return (f"q{i}", datetime(2024, 1, 1) + timedelta(minutes=i), f"e{i:04d}", user, account, query, workgroup, database, "", size, ms)


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        fact(1, "ann", "SELECT * FROM a WHERE x = 1"),
        fact(2, "bob", "SELECT * FROM a WHERE x = 2", account="2", size=5, ms=30),
        fact(3, "bob", "SELECT * FROM a WHERE x = 'z'", "etl", size=7),
        fact(4, "ann", "DROP TABLE b", "etl", "other", account="2"),
        fact(5, "ann", "SELECT * FROM a JOIN c ON 1 = 1"),
    ]
    return spark.createDataFrame(rows, FACTS)


def test_query_patterns(spark, facts):
    got = {tuple(r)[1:] for r in us.query_patterns(facts).collect()}
    # count, bytes, ms, users, workgroups, databases, tables, average
    assert got == {
        (2, 6, 40, 2, 1, 1, 1, 20.0),
        (1, 7, 10, 1, 1, 1, 1, 10.0),
        (1, 1, 10, 1, 1, 1, 0, 10.0),
        (1, 1, 10, 1, 1, 1, 2, 10.0),
    }


def test_pattern_examples_are_distinct_and_first(spark):
    texts = ["select 'a' from t", "select  'b' from t", "select 'c' from t", "SELECT 'd' from t"]
    facts = spark.createDataFrame([fact(i, "u", t) for i, t in enumerate(texts)], FACTS)
    got = us.pattern_examples(facts, 2).orderBy("rank").collect()
    assert [r.example for r in got] == ["select '<VALUE>' from t", "select  '<VALUE>' from t"]


def test_members_and_sums(spark):
    rows = spark.createDataFrame(
        [("a", "u1", ["t1", "t2"], 1), ("a", "u1", ["t2"], 2), ("a", None, None, 3), ("b", "u2", [], 4)],
        "k string, u string, ts array<string>, n bigint",
    )
    long = mb.member_rows(rows, ["k"], {"user": "u", "table": "ts"}, ["n"])
    got = mb.count_members(long, ["k"], {"user": "users", "table": "tables"}, ["n"])
    assert {tuple(r) for r in got.collect()} == {("a", 6, 1, 2), ("b", 4, 1, 0)}
    names = {tuple(r) for r in mb.distinct_members(rows, ["k"], {"table": "ts"}).collect()}
    assert names == {("a", "table", "t1"), ("a", "table", "t2")}


def test_global_rank_equals_a_full_sort(spark):
    rng = random.Random(7)
    rows = [(f"{rng.getrandbits(48):012x}", rng.choice([1, 1, 1, 2, 2, 9, 50])) for _ in range(3000)]
    got = rk.global_rank(spark.createDataFrame(rows, "h string, n bigint"), "n", "h")
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r.h for r in got.orderBy("rank").collect()] == [h for h, _ in want]
    assert [r.rank for r in got.orderBy("rank").collect()] == list(range(1, 3001))


@pytest.mark.parametrize("n", [1, 2, 7, 8, 100, 999])
def test_execution_time_positions(spark, n):
    rng = random.Random(n)
    times = [rng.choice([5, 5, 70_000, 300_000, rng.randrange(1, 9_000_000)]) for _ in range(n)]
    log = spark.createDataFrame([(t,) for t in [*times, 0, -4]] + [(None,)], "execution_time_ms bigint")
    got = ql.execution_time_stats(log).first()
    order = sorted(times)
    assert (got.query_count, got.min_ms, got.max_ms) == (n, order[0], order[-1])
    assert (got.p50_ms, got.p95_ms) == (order[n // 2], order[int(n * 0.95)])
    assert got.avg_ms == pytest.approx(sum(times) / n)
    fast = ql.execution_time_stats_fast(log).first()
    assert (fast.query_count, fast.min_ms, fast.max_ms) == (n, order[0], order[-1])


def test_empty_log(spark):
    log = spark.createDataFrame([], "query_string string, execution_time_ms bigint, status string, event_time timestamp, event_id string")
    assert ql.execution_time_stats(log).first().query_count is None
    assert [r.query_count for r in ql.execution_time_histogram(log).collect()] == [0] * 7
    assert ql.peak_concurrency(log).first()[0] == 0
    assert tuple(ql.complexity_totals(ql.classify_log(log)).first()) == (0, 0, 0)


def log_rows(spark, *rows):
    names = "event_id string, event_time string, user_id string, status string, error_message string, state_change_reason string, query_string string, query string, workgroup string, execution_time_ms bigint, data_scanned_bytes bigint"
    return ql.query_log(spark.createDataFrame(rows, names))


def test_query_log_and_errors(spark):
    log = log_rows(
        spark,
        ("1", "2024-01-01T10:00:30Z", "ann", "failed", "", "Query timed out", "", "SELECT 1", "wg", 5, 0),
        ("2", "bad", None, "FAILED", None, None, None, None, None, None, None),
        ("3", "2024-01-01T10:00:59Z", "ann", "succeeded", None, None, "SELECT 2", "", "wg", 700_000, 9),
        ("4", "2024-01-01T10:01:00Z", "bob", "", None, None, "SELECT 3", "", "", 10, 3),
    )
    rows = {r.event_id: r for r in log.collect()}
    assert (rows["1"].query_string, rows["1"].error_message, rows["1"].status) == ("SELECT 1", "Query timed out", "FAILED")
    assert rows["2"].user_id == "unknown" and rows["2"].event_time is None
    assert {tuple(r)[:2] for r in ql.status_counts(log).collect()} == {("FAILED", 2), ("SUCCEEDED", 1)}
    assert tuple(ql.failure_rate(log).first())[:3] == (1, 2, 3)
    assert {tuple(r) for r in ql.error_type_counts(log).collect()} == {("Timeout", 1), ("Other Error", 1)}
    ranked = {r.error_type: r.example for r in ql.errors_ranked(log).collect()}
    assert ranked == {"Timeout": "Query timed out", "Other Error": None}
    assert ql.peak_concurrency(log).first()[0] == 2
    assert tuple(ql.long_running_totals(log).first()) == (1, 0, 0)
    assert {tuple(r) for r in ql.data_scanned_by_workgroup(log).collect()} == {("wg", 9)}
    period = ql.analysis_period(log).first()
    assert (period.days, period.hours) == (0, 0)
    assert ql.avg_queries_per_day(log, log).first().avg_queries_per_day == 0.0


def test_weighted_texts_equal_single_rows(spark):
    texts = ["SELECT 1"] * 5 + ["WITH a AS (SELECT 1) SELECT * FROM a JOIN b JOIN c JOIN d"] * 3 + ["", None]
    log = spark.createDataFrame([(t,) for t in texts], "query_string string")
    rows, cells = ql.classify_log(log), ql.classify_log(ql.text_cells(log))
    for table in (ql.sql_feature_counts, ql.join_type_counts, ql.complexity_totals, ql.partition_filter_totals, ql.migration_flag_counts):
        assert sorted(map(tuple, table(rows).collect())) == sorted(map(tuple, table(cells).collect()))
    assert tuple(ql.complexity_totals(cells).first()) == (3, 3, 3)


def test_types_other_and_share(spark):
    rows = spark.createDataFrame([(f"t{i}", i) for i in range(1, 12)], "t string, n bigint")
    got = {r.t: r.n for r in rk.top_k_and_other(rows, "t", "n", 8).collect()}
    assert got["Other"] == 6 and len(got) == 9 and got["t11"] == 11
    shares = rk.with_share(rows, "n").agg(F.sum("pct")).first()[0]
    assert shares == pytest.approx(100)


def test_bucket_tables(spark):
    rows = spark.createDataFrame(
        [
            ("GetObject", "b", "a/b/c", "u", 0, None, 4, None),
            ("GetObject", "b", "a/b/d", "v", 20 * 2**20, None, None, None),
            ("PutObject", "b", "", "u", None, 7, None, 99),
            ("HeadObject", "b", "x", "u", 5, None, None, None),
            ("ListObjects", "", "x", "u", 5, None, None, None),
        ],
        "event_name string, bucket string, key string, user_id string, bytes_transferred bigint, object_size bigint, extra_bytes_out bigint, extra_bytes_in bigint",
    )
    assert [tuple(r) for r in so.s3_bucket_stats(rows).collect()] == [("b", 2, 1, 0, 2, 2)]
    assert tuple(so.s3_totals(rows).first()) == (3, 20 * 2**20 + 4, 99)
    sizes = so.object_size_stats(rows).first()
    assert (sizes.object_count, sizes.small_count, sizes.tier) == (3, 2, "under 10 MiB")
    assert so.object_size_stats(rows.limit(0)).first().tier is None


def test_account_rollup_counts_a_shared_member_once(spark, facts):
    events = facts.select("account_id", "user_id", "event_time")
    objects = spark.createDataFrame([("1", "ann", "b"), ("2", "ann", "b"), ("2", "bob", "b")], "account_id string, user_id string, bucket string")
    rows = {(r.account_id, r.level, r.name): r for r in ov.account_rollup(facts, events, objects).collect()}
    assert (rows["ALL", "bucket", "b"].query_count, rows["ALL", "bucket", "b"].unique_members) == (3, 2)
    assert {level for _, level, _ in rows} >= {"user_database", "pattern", "query_type", "hour", "database_table"}
    assert (rows["1", "workgroup", "wg"].query_count, rows["1", "workgroup", "wg"].unique_members) == (2, 1)
    total = rows["ALL", "workgroup", "wg"]
    assert (total.query_count, total.unique_members, total.data_scanned) == (3, 2, 7)
    assert rows["ALL", "user", "ann"].last_activity > rows["2", "user", "bob"].last_activity


def test_per_account_first_source(spark):
    def run(*rows):
        df = spark.createDataFrame(rows, "file string, source string, account_id string")
        return sorted((r.file, r.source) for r in ov.per_account_first_source(df).collect())

    assert run(("a", "member", "1"), ("b", "member", "2")) == [("a", "member")]
    assert run(("a", "summary", "1"), ("a", "member", "1")) == [("a", "summary")]
    assert run(("a", "member", "1"), ("b", "summary", "2"), ("b", "member", "2")) == [("a", "member"), ("b", "summary")]


def test_top_users_show_three_groups(spark):
    rows = [fact(i, "ann", "SELECT 1", w) for i, w in enumerate("dcba")] + [fact(9, "bob", "SELECT 1", "z")]
    facts = spark.createDataFrame(rows, FACTS)
    got = {r.user_id: r.workgroups for r in us.top_users(facts, facts).collect()}
    assert got == {"ann": "a, b, c...", "bob": "z"}


def test_hot_group_stays_spread(spark):
    """Distinct users of a workgroup that holds all rows shuffle by member."""
    hot = spark.range(20_000).select(
        F.concat(F.lit("wg"), (F.col("id") % 1).cast("string")).alias("k"), F.col("id").cast("string").alias("u"), F.lit(1).cast("bigint").alias("n")
    )
    long = mb.member_rows(hot, ["k"], {"user": "u"}, ["n"])
    assert mb.count_members(long, ["k"], {"user": "users"}, ["n"]).first()[1:] == (20_000, 20_000)
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" in plan and "kind#" in plan and "partial_sum" in plan


def test_report_tables_over_a_stored_classified_log(spark, folder):
    from loglens.plans.analyser import report_tables, store_classified

    log = log_rows(
        spark,
        ("1", "2024-01-01T10:00:30Z", "ann", "FAILED", "oom", "", "SELECT * FROM a JOIN b JOIN c JOIN d", "", "wg", 5_000_000, 7),
        ("2", "2024-01-03T12:00:00Z", "bob", "SUCCEEDED", "", "", "DROP TABLE t", "", "wg", 10, 0),
    ).withColumn("query_id", F.col("event_id"))
    store = spark.createDataFrame(
        [("GetObject", "raw", "a/b", "u", 5, None, None, None, None)],
        "event_name string, bucket string, key string, user_id string, bytes_transferred bigint, object_size bigint, extra_bytes_out bigint, extra_bytes_in bigint, event_time timestamp",
    )
    tables = report_tables(store_classified(log, f"{folder}/c"), store)
    rows = {name: table.collect() for name, table in tables.items()}
    assert rows["complexity_totals"][0].high_complexity == 1
    assert rows["readiness_score"][0].drop_operations == 1
    assert (rows["analysis_period"][0].days, rows["analysis_period"][0].hours) == (2, 1)
    assert rows["first_high_complexity"][0].join_types == "JOIN, JOIN, JOIN"
    assert rows["longest_queries"][0].execution_time_min == 83.3
    assert len(rows["recommendations"]) == 3
    lazy = report_tables(ql.classify_log(log), store)
    for name in ("ddl_by_type", "join_types_ranked", "flags_ranked", "ddl_samples_by_type"):
        assert rows[name] == lazy[name].collect()


def test_first_k_and_count_equals_window_and_count(spark):
    from loglens.operators.ranking import first_k_and_count

    rows = spark.range(5000, numPartitions=7).select(
        F.when(F.col("id") % 11 > 0, F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40))).alias("kind"),
        F.when(F.col("id") % 13 > 0, F.pmod(F.xxhash64("id"), F.lit(50))).alias("event_time"),
        F.col("id").cast("string").alias("event_id"),
    )
    order = ["event_time", "event_id"]
    got = sorted(first_k_and_count(rows, "kind", order, 4).select("kind", *order, "rank", "total").collect(), key=str)
    rows.createOrReplaceTempView("kinds")
    want = spark.sql(
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY event_time, event_id) AS rank,
        count(*) OVER (PARTITION BY kind) AS total FROM kinds) WHERE rank <= 4"""
    )
    assert got == sorted(want.collect(), key=str) and {r.kind for r in got} >= {None, "hot"}
    assert first_k_and_count(rows.limit(0), "kind", order, 4).count() == 0


def _in_batches_of(spark, size, rows):
    """The collected rows, with Arrow batches of a few rows as in a large table."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        return rows.collect()
    finally:
        spark.conf.set(name, before)


def _logged(spark, text, n=40):
    rows = spark.range(n, numPartitions=1).select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("event_time"),
        F.format_string("e%02d", "id").alias("event_id"), F.format_string("q%02d", "id").alias("query_id"), F.lit("u").alias("user_id"),
        F.lit(text).alias("query_string"),
    )
    return ql.classify_log(rows)


def test_ddl_samples_of_several_batches_a_task(spark):
    got = _in_batches_of(spark, 7, ql.ddl_samples_by_type(_logged(spark, "DROP TABLE b"), 3))
    assert sorted((r.ddl_type, r["rank"], r.more_queries) for r in got) == [("DROP", k, 37) for k in (1, 2, 3)]


def test_first_high_complexity_of_several_batches_a_task(spark):
    text = "SELECT 1 FROM a JOIN b ON 1 = 1 JOIN c ON 1 = 1 JOIN d ON 1 = 1"
    got = _in_batches_of(spark, 7, ql.first_high_complexity(_logged(spark, text)))
    assert [(r.query_id, r.more_queries) for r in got] == [(f"q{k:02d}", 30) for k in range(10)]


def test_first_k_and_count_in_a_session_started_elsewhere(tmp_path):
    """Python workers find the package, though neither their folder nor PYTHONPATH names it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    body = f"""import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from loglens.operators.ranking import first_k_and_count
from loglens.session import get_spark
spark = get_spark("elsewhere", "local[1]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
rows = spark.range(9).select(F.lit("all").alias("of"), "id")
print("ROWS", sorted((r.id, r["rank"], r.total) for r in first_k_and_count(rows, "of", ["id"], 2).collect()))
spark.stop()
"""
    (tmp_path / "job.py").write_text(body)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "job.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS [(0, 1, 9), (1, 2, 9)]" in run.stdout, run.stderr[-2000:]
