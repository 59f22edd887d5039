import pytest

from pyspark.sql import functions as F

from loglens import rules
from loglens.operators import readiness as rd, store as so
from loglens.session import store_table

GEO = "SELECT ST_Contains(a, b) FROM t WHERE x = 1"
HIGH = "SELECT * FROM a JOIN b JOIN c JOIN d WHERE x = 1"
PLAIN = "SELECT a FROM t WHERE x = 1"


def log(spark, *parts):
    rows = [(text, ms) for text, n, ms in parts for _ in range(n)]
    return spark.createDataFrame(rows, "query_string string, execution_time_ms bigint")


def score(spark, *parts):
    return rd.readiness_score(log(spark, *parts)).first()


@pytest.mark.parametrize(
    "high, points, word", [(11, 30, "HIGH: 11.0%"), (10, 20, "MEDIUM: 10.0%"), (5, 10, "LOW: 5.0%"), (1, 0, None)]
)
def test_complexity_rungs(spark, high, points, word):
    row = score(spark, (HIGH, high, 1), (PLAIN, 100 - high, 1))
    assert (row.score, row.complexity) == (100 - points, points)
    assert (row.considerations[0].startswith(word) if word else row.considerations == [])


@pytest.mark.parametrize("drops, points", [(21, 20), (20, 15), (11, 15), (10, 10), (6, 10), (5, 0)])
def test_drop_rungs(spark, drops, points):
    row = score(spark, ("DROP TABLE t", drops, 1), (PLAIN, 5, 1))
    assert row.complexity == points and row.drop_operations == drops


@pytest.mark.parametrize(
    "over_1h, over_30m, over_10m, points", [(6, 0, 0, 20), (5, 6, 0, 15), (5, 5, 21, 10), (5, 5, 20, 0)]
)
def test_long_running_rungs(spark, over_1h, over_30m, over_10m, points):
    row = score(spark, (PLAIN, over_1h, 3_600_000), (PLAIN, over_30m, 1_800_000), (PLAIN, over_10m, 600_000))
    assert row.complexity == points
    assert row.long_running_queries == over_1h + over_30m + over_10m


@pytest.mark.parametrize("scans, points", [(31, 15), (30, 10), (15, 0)])
def test_scan_rungs(spark, scans, points):
    row = score(spark, ("SELECT a FROM t", scans, 1), (PLAIN, 100 - scans, 1))
    assert row.complexity == points and row.full_table_scans == scans


@pytest.mark.parametrize("flagged", [1, 30])
def test_every_flagged_query_counts(spark, flagged):
    row = score(spark, (GEO, flagged, 1), (PLAIN, 10, 1))
    assert (row.complexity, row.compatibility_flags) == (15 if flagged > 20 else 0, flagged)


def test_score_and_advice_of_a_classified_log(spark):
    """Tags are used as they are stored: no pattern is matched again."""
    from loglens.operators.querylog import classify_log

    rows = log(spark, (GEO, 30, 1), (HIGH, 9, 3_600_000), ("DROP TABLE t", 12, 1), (PLAIN, 10, 700_000))
    tagged = classify_log(rows.withColumn("event_time", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    tagged = store_table(tagged.select("query_string", "execution_time_ms", "flags", "complexity", "partitions", "ddl"), "tagged")
    sizes = spark.createDataFrame([], "event_name string, bytes_transferred long, object_size long, extra_bytes_in long, extra_bytes_out long, bucket string, key string, user_id string")
    assert rd.readiness_score(tagged).collect() == rd.readiness_score(rows).collect()
    assert rd.recommendations(tagged, sizes).collect() == rd.recommendations(rows, sizes).collect()
    plan = rd.readiness_score(tagged)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and "rlike" not in plan.lower()


def test_level_and_sum(spark):
    row = score(spark, (HIGH, 50, 3_600_000), ("DROP TABLE t", 25, 1), ("SELECT a FROM t", 60, 1))
    assert (row.score, row.level) == (100 - 30 - 20 - 20 - 15, "LOW")
    assert len(row.considerations) == 4


def test_empty_text_rows_count_as_events_only(spark):
    row = score(spark, (HIGH, 1, 1), ("", 50, 3_600_000), (None, 49, 3_600_000))
    assert row.complexity == 0 and row.long_running_queries == 0


def store(spark, *sizes):
    rows = [("GetObject", "b", "k", "u", s, None, None, None) for s in sizes]
    return spark.createDataFrame(
        rows,
        "event_name string, bucket string, key string, user_id string, bytes_transferred bigint, object_size bigint, extra_bytes_out bigint, extra_bytes_in bigint",
    )


def test_recommendations(spark):
    none = rd.recommendations(log(spark, (PLAIN, 1, 1)), store(spark))
    assert [tuple(r) for r in none.collect()] == [(1, rules.ADVICE["none"])]
    some = rd.recommendations(log(spark, (HIGH, 2, 3_600_000), (GEO, 9, 1)), store(spark, 1000))
    lines = [r.recommendation for r in some.orderBy("rank").collect()]
    assert lines == [
        rules.ADVICE["complex"] % 2,
        rules.ADVICE["long"] % 2,
        rules.ADVICE["small"],
        rules.ADVICE["geo"] % 9,
    ]
    assert so.object_size_stats(store(spark, 60 * 2**20)).first().tier == "ok"
