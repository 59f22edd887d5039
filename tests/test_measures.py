from pyspark.sql import functions as F

from loglens import functions as fn, rules


def one(spark, column, **values):
    names = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def many(spark, values, column, kind="bigint"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", column.alias("x")).orderBy("i").collect()]


def test_error_classes(spark):
    cases = {
        "Query TIMED OUT": "Timeout",
        "no room left": "Memory Exceeded",
        "SYNTAX error": "Syntax Error",
        "cannot parse": "Syntax Error",
        "user is not authorized": "Permission Denied",
        "Table does not exist": "Resource Not Found",
        "type mismatch": "Type Error",
        "type A cannot be B": "Type Error",
        "division by zero": "Division By Zero",
        "rate limit": "Limit Exceeded",
        "was canceled": "Query Cancelled",
        "INTERNAL": "Internal Error",
        "type": "Other Error",
        "": "Other Error",
        None: "Other Error",
    }
    assert many(spark, cases, fn.error_class("v"), "string") == list(cases.values())


def test_time_buckets_and_classes(spark):
    edges = [0, 999, 1000, 4999, 5000, 29999, 30000, 59999, 60000, 299999, 300000, 599999, 600000]
    labels = [label for _, label in rules.TIME_BUCKETS]
    want = [labels[i] for i in (0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6)]
    assert many(spark, edges, fn.execution_time_bucket("v")) == want
    ms = [599_999, 600_000, 1_799_999, 1_800_000, 3_599_999, 3_600_000]
    assert many(spark, ms, fn.long_running_class("v")) == [
        None, "over_10m", "over_10m", "over_30m", "over_30m", "over_1h",
    ]
    # 10.25 and 10.75 minutes are ties: the even digit wins, as round() has it.
    ties = [615_000, 645_000, 612_000, 600_001]
    assert many(spark, ties, fn.long_running_minutes("v")) == [round(t / 60000, 1) for t in ties]


BYTE_TEXTS = {
    0: "0 B",
    1: "1.0 B",
    1023: "1023.0 B",
    1024: "1.0 KB",
    1280: "1.2 KB",
    1792: "1.8 KB",
    1048575: "1024.0 KB",
    1048576: "1.0 MB",
    5368709120: "5.0 GB",
    3377699720527872: "3.0 PB",
    1152921504606846976: "1024.0 PB",
}


def test_format_bytes(spark):
    assert many(spark, BYTE_TEXTS, fn.format_bytes("v")) == list(BYTE_TEXTS.values())


def test_gigabytes_ties_to_even(spark):
    sizes = [0, 2**25, 3 * 2**25, 123456789]
    assert many(spark, sizes, fn.gigabytes("v", 4)) == [f"{n / 2**30:.4f}" for n in sizes]


def test_previews_and_fallbacks(spark):
    assert many(spark, ["abcdef", "abc", None], fn.truncate_preview("v", 3, "..."), "string") == ["abc...", "abc", None]
    assert many(spark, ["abcdef"], fn.truncate_preview("v", 3), "string") == ["abc"]
    assert one(spark, fn.prefer_non_empty("a", "b"), a="", b="y") == "y"
    assert one(spark, fn.nonzero("a", "b"), a=0, b=7) == 7
    rows = spark.createDataFrame([(None, None)], "a string, b string")
    assert rows.select(fn.prefer_non_empty("a", "b")).first()[0] == ""


def test_user_ids(spark):
    cases = [
        ("arn:aws:iam::1:user/team/ann", "P", "ann"),
        ("arn:aws:iam::1:root", "P", "root"),
        ("plain", "P", "plain"),
        ("unknown", "P", "P"),
        ("", "P", "P"),
        (None, "", "unknown"),
        (None, None, "unknown"),
    ]
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, a string, p string")
    got = rows.select("i", fn.user_id("a", "p").alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == [c[2] for c in cases]


def test_times_and_keys(spark):
    texts = ["2024-03-05T06:07:08Z", "2024-03-05T06:07:08+02:00", "nope", "2024", "", None]
    parsed = many(spark, texts, fn.hour_key(fn.parse_event_time("v")), "string")
    assert parsed == ["2024-03-05T06", "2024-03-05T04", None, None, None, None]
    assert many(spark, texts[:1], fn.day_key(fn.parse_event_time("v")), "string") == ["2024-03-05"]
    assert many(spark, texts[:1], fn.minute_key(fn.parse_event_time("v")), "string") == ["2024-03-05 06:07"]


def test_store_names(spark):
    assert many(spark, ["a/b/c", "a", "", "a/b"], fn.object_prefix("v"), "string") == ["a/b", "a", None, "a/b"]
    names = ["GetObject", "PutObject", "ListObjectsV2", "HeadObject"]
    assert many(spark, names, fn.s3_operation("v"), "string") == ["get", "put", "list", None]


def test_feature_notes(spark):
    tags = ["CTE", "Trino: TRY()", "Array Literals"]
    got = many(spark, tags, fn.feature_note("v"), "string")
    assert got == [rules.FEATURE_NOTES["CTE"], rules.DIALECT_NOTE, rules.DEFAULT_NOTE]


def test_share(spark):
    rows = spark.createDataFrame([(1, 4), (0, 0)], "a bigint, b bigint")
    got = rows.select(fn.share_pct(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [25.0, 0.0]
