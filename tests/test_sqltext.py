"""Hand-written cases for every rule on SQL text."""

import hashlib
import re

from loglens import functions as fn, rules


def apply(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string")
    return [r.x for r in rows.select("i", column.alias("x")).orderBy("i").collect()]


STATEMENTS = {
    "  select 1": "SELECT",
    "\n\tSELECT 1": "SELECT",
    "SELECT a AS SELECTED": "CTAS",
    "CREATE TABLE t AS SELECT 1": "CREATE_TABLE",
    "create view v as select 1": "CREATE_VIEW",
    "CREATE EXTERNAL TABLE t (a int)": "OTHER",
    "DROP TABLE t": "DROP",
    "ALTER TABLE t ADD COLUMNS (a int)": "ALTER",
    "INSERT INTO t VALUES (1)": "INSERT",
    "SHOW TABLES": "SHOW",
    "DESCRIBE t": "DESCRIBE",
    "MSCK REPAIR TABLE t": "MSCK_REPAIR",
    "UNLOAD (SELECT 1) TO 's3://x'": "UNLOAD",
    "WITH a AS (SELECT 1) SELECT 1": "OTHER",
    "": "OTHER",
}


def test_statement_types(spark):
    got = apply(spark, STATEMENTS, fn.classify_query("q"))
    assert dict(zip(STATEMENTS, got)) == STATEMENTS


TABLES = {
    "SELECT * FROM a.b JOIN c ON 1=1": {"a.b", "c"},
    "select x from T1, t2": {"T1"},
    "SELECT EXTRACT(day FROM ts) FROM logs": {"ts", "logs"},
    "SELECT * FROM (SELECT 1)": set(),
    'SELECT * FROM "quoted"': set(),
    "SELECT * FROM a.b.c": {"a.b"},
    "SELECT * FROM select": set(),
    "SELECT * FROM\n  t1\nJOIN\tt2 ON x": {"t1", "t2"},
    "FROM JOIN x": {"JOIN", "x"},
}


def test_tables(spark):
    got = apply(spark, TABLES, fn.extract_tables("q"))
    assert [set(g) for g in got] == list(TABLES.values())
    assert all(len(g) == len(set(g)) for g in got)


# Texts with the form in which they are hashed.
FORMS = {
    "SELECT * FROM t WHERE a = 'x' AND b = 12.50 AND c1 = 3": "SELECT * FROM T WHERE A = '?' AND B = ? AND C1 = ?",
    "  select *\n from\tt where a = 'it''s' ": "SELECT * FROM T WHERE A = '?''?'",
    "SELECT 'open": "SELECT 'OPEN",
    "SELECT '' , \"\"": "SELECT '?' , \"\"",
    "SELECT É, 'ü' FROM t": "SELECT É, '?' FROM T",
    "SELECT 1e5 -- note 5\n FROM t1": "SELECT 1E5 -- NOTE ? FROM T1",
    "SELECT 1.\x1f2": "SELECT ?. ?",
    "": "",
}


def digest(form):
    return hashlib.sha256(form.encode()).hexdigest()[:12]


def test_fingerprint_hashes_the_form(spark):
    assert apply(spark, FORMS, fn.query_fingerprint("q")) == [digest(form) for form in FORMS.values()]


def test_fingerprint_joins_texts_that_differ_in_literals(spark):
    same = ["SELECT * FROM t WHERE id = 1 AND n = 'a'", "select *  from t\nwhere id = 99 and n = 'b'"]
    one, two = apply(spark, same, fn.query_fingerprint("q"))
    assert one == two and len(one) == 12


def test_masking(spark):
    cases = {
        "SELECT * FROM t WHERE a = 'secret' AND b = 42": "SELECT * FROM t WHERE a = '<VALUE>' AND b = <NUM>",
        "SELECT 'it\\'s' x -- pw 1\nFROM t": "SELECT '<VALUE>' x \nFROM t",
        'SELECT "col" /* hidden\n2 */ FROM t1': 'SELECT "<VALUE>"  FROM t1',
        "SELECT 'a''b'": "SELECT '<VALUE>''<VALUE>'",
        "SELECT 'open 5": "SELECT 'open <NUM>",
    }
    got = apply(spark, cases, fn.sanitize_query("q"))
    assert got == list(cases.values())
    assert not any("secret" in g for g in got)


def test_masking_cuts_and_takes_any_length(spark):
    long = "SELECT a" + "b" * 2000
    literal = "SELECT '" + "x" * 200_000 + "\\'" + "y" * 1000 + "' FROM t"
    cut, masked = apply(spark, [long, literal], fn.sanitize_query("q"))
    assert cut == long[:1000] + "..." and len(cut) == 1003
    assert masked == "SELECT '<VALUE>' FROM t"


FEATURES = {
    "WITH a AS (SELECT 1) SELECT * FROM a": {"CTE"},
    "SELECT row_number() over (order by a) FROM t": {"Window Functions"},
    "SELECT LAG(a) x FROM t": {"Window Functions"},
    "SELECT * FROM t CROSS JOIN UNNEST(a)": {"UNNEST", "CROSS JOIN UNNEST"},
    "SELECT transform(a, x -> x + 1)": {"Lambda Expressions", "Array/Map Functions"},
    "SELECT TRY_CAST(a AS int), try(b)": {"Trino: TRY()", "Trino: TRY_CAST()"},
    "SELECT approx_percentile(a, 0.5)": {"Trino: APPROX_PERCENTILE()"},
    "SELECT MAP_AGG(a,b), ARRAY_AGG(c)": {"Trino: MAP_AGG()", "Trino: ARRAY_AGG()"},
    "SELECT json_extract_scalar(a, '$.b')": {"Trino: JSON_EXTRACT_SCALAR()"},
    "SELECT CAST(x AS ROW(a int))": {"Trino: ROW Type Cast", "Row/Struct Types"},
    "SELECT CAST(x AS MAP(a, b))": {"Trino: MAP Type Cast", "Map Literals"},
    "SELECT ARRAY[1,2]": {"Array Literals"},
    "SELECT MAP{'a':1}": {"Map Literals"},
    "SELECT map{'a':1}": set(),
    "SELECT a FROM t GROUP BY GROUPING SETS ((a))": {"GROUPING SETS"},
    "SELECT a FROM t GROUP BY CUBE (a)": {"CUBE"},
    "SELECT a FROM t GROUP BY ROLLUP(a)": {"ROLLUP"},
    "SELECT * FROM t TABLESAMPLE BERNOULLI(1)": {"TABLESAMPLE"},
    "SELECT * FROM ( SELECT 1 ) x": {"Derived Tables"},
    "SELECT * FROM t, LATERAL (SELECT 1)": {"LATERAL"},
    "SELECT date_trunc('day', d), DATE_ADD('day', 1, d), date_diff('day', a, b)": {
        "Trino: DATE_TRUNC()", "Trino: DATE_ADD()", "Trino: DATE_DIFF()",
    },
    "SELECT HISTOGRAM(a), SEQUENCE(1,2), REPEAT('a',2), MULTIMAP_AGG(a,b)": {
        "Trino: HISTOGRAM()", "Trino: SEQUENCE()", "Trino: REPEAT()", "Trino: MULTIMAP_AGG()",
    },
    "SELECT FROM_UNIXTIME(a), TO_UNIXTIME(b)": {"Trino: FROM_UNIXTIME()", "Trino: TO_UNIXTIME()"},
    "SELECT mytry(a) FROM covers": set(),
    "": set(),
}


def test_features(spark):
    got = apply(spark, FEATURES, fn.sql_features("q"))
    assert {t: set(g) for t, g in zip(FEATURES, got)} == FEATURES


def test_rule_table_sizes_and_needles():
    assert len({r.tag for r in rules.FEATURE_RULES}) == 35
    assert len(rules.FLAG_RULES) == 13
    assert len(rules.QUERY_EVENT_NAMES) == 34


def test_features_of_null_and_own_rules(spark):
    own = (rules.Rule("NVL", r"\bNVL\s*\(", ("NVL",)),)
    rows = spark.createDataFrame([(None,), ("select nvl (a, 1)",)], "q string")
    got = rows.select(fn.sql_features("q").alias("a"), fn.sql_features("q", rule_rows=own).alias("b"))
    assert [tuple(r) for r in got.collect()] == [([], []), ([], ["NVL"])]


FLAGS = {
    "CREATE TABLE a AS SELECT 1": {"CTAS"},
    "CREATE TABLE a\nAS SELECT 1": {"CTAS"},
    "CREATE TABLE a\nb AS SELECT 1": set(),
    "CREATE TABLE a WITH (x=1) AS SELECT 1": {"CTAS"},
    "INSERT INTO t PARTITION (dt='1') SELECT 1": {"INSERT_WITH_PARTITION"},
    "INSERT INTO\n t PARTITION (dt='1') SELECT 1": {"INSERT_WITH_PARTITION"},
    "INSERT INTO t \nPARTITION (dt='1') SELECT 1": set(),
    "CREATE TABLE t (a int) USING iceberg": {"ACID_TABLE"},
    "MERGE INTO t USING s ON 1=1": {"MERGE_INTO"},
    "DELETE FROM t WHERE a=1": {"DELETE_FROM"},
    "UPDATE t SET a=1": {"UPDATE"},
    "SELECT ST_Contains(a, b)": {"GEOSPATIAL"},
    "SELECT POINT (1, 2)": {"GEOSPATIAL"},
    "SELECT json_extract(a, '$.b')": {"JSON_EXTRACT", "JSONPATH"},
    "SELECT * FROM a.b.c.d": {"FEDERATED_QUERY"},
    "SELECT * FROM a.b.c": set(),
    "UNLOAD (SELECT 1) TO 's3://x'": {"UNLOAD"},
    " EXPLAIN SELECT 1": {"EXPLAIN"},
    "PREPARE p FROM SELECT 1": {"PREPARED_STATEMENTS"},
    "SELECT executed FROM t": set(),
}


def test_flags(spark):
    got = apply(spark, FLAGS, fn.migration_flags("q"))
    assert {t: set(g) for t, g in zip(FLAGS, got)} == FLAGS


JOINS = {
    "SELECT * FROM a JOIN b ON 1=1 LEFT JOIN c ON 1=1": ["LEFT", "JOIN"],
    "SELECT * FROM a LEFT OUTER JOIN b RIGHT OUTER JOIN c FULL OUTER JOIN d": ["LEFT OUTER", "RIGHT OUTER", "FULL OUTER"],
    "SELECT * FROM a FULL JOIN b": [],
    "SELECT * FROM a LEFT  JOIN b INNER\nJOIN c": ["LEFT", "INNER", "JOIN"],
    "SELECT * FROM a_left JOIN b CROSS JOIN c": ["CROSS"],
    "JOIN x": ["JOIN"],
    "SELECT left FROM t JOIN u": ["JOIN"],
    "SELECT 1": [],
}


def test_complexity_joins(spark):
    from loglens.operators.querylog import classify_log
    from loglens.functions.sqltext import join_types

    rows = spark.createDataFrame(list(enumerate(JOINS)), "i int, query_string string")
    got = classify_log(rows).select("i", join_types().alias("k"), "complexity.join_count").orderBy("i")
    for row, text in zip(got.collect(), JOINS):
        assert row.k == JOINS[text], text
        assert row.join_count == len(row.k)


def test_complexity_counts(spark):
    texts = [
        "WITH a AS (SELECT 1), b AS (SELECT 2) SELECT * FROM a UNION ALL SELECT * FROM b UNION SELECT 3",
        "SELECT a, COUNT(*) FROM t",
        "SELECT COUNT(*)",
        "SELECT SUM(a) FROM t GROUP BY b",
        "SELECT COUNT( * )\n",
        "select max(a) from ( select 1 )",
    ]
    got = apply(spark, texts, fn.query_complexity("q"))
    shown = [
        (c.cte_count, c.subquery_count, c.union_count, c.has_group_by, c.has_aggregation, c.potential_missing_group_by)
        for c in got
    ]
    assert shown == [
        (1, 2, 2, False, False, False),
        (0, 0, 0, False, True, True),
        (0, 0, 0, False, True, False),
        (0, 0, 0, True, True, False),
        (0, 0, 0, False, True, False),
        (0, 1, 0, False, True, True),
    ]


DDL = {
    "CREATE TABLE a.b (x int)": ("CREATE", "B"),
    "create or replace view v as select 1": ("CREATE", "V"),
    "CREATE EXTERNAL TABLE IF NOT EXISTS `db`.`t` (x int)": ("CREATE", "T"),
    "DROP TABLE IF EXISTS t1": ("DROP", "T1"),
    "DROP SCHEMA s": ("DROP", "unknown"),
    "ALTER TABLE \"t\" ADD COLUMNS (a int)": ("ALTER", "T"),
    "TRUNCATE TABLE t": ("TRUNCATE", "T"),
    "MSCK REPAIR TABLE t": ("REPAIR", "T"),
    "CREATE DATABASE d": ("CREATE", "unknown"),
    "SELECT 1": None,
    "EXPLAIN DROP TABLE t": None,
}


def test_ddl(spark):
    rows = spark.createDataFrame([(i, t, None if i == 0 else "2024-01-01 07:30:00") for i, t in enumerate(DDL)], "i int, q string, t string")
    got = rows.withColumn("t", rows.t.cast("timestamp")).select("i", fn.ddl_operation("q", "t").alias("d")).orderBy("i").collect()
    assert [(r.d.type, r.d.object) if r.d else None for r in got] == list(DDL.values())
    assert got[0].d.hour == 0 and got[1].d.hour == 7


PARTITIONS = {
    "SELECT * FROM t WHERE dt = '1' AND year > 3": (True, {"dt", "year"}, False),
    "SELECT * FROM t WHERE day BETWEEN 1 AND 2": (True, set(), False),
    "SELECT * FROM t WHERE date(x) = 1": (True, set(), False),
    "SELECT * FROM t WHERE region != 'x'": (True, set(), False),
    "SELECT * FROM t WHERE a=1\n AND dt = 1": (True, set(), False),
    "SELECT * FROM t WHERE a=1\r AND DT = 1": (True, {"dt"}, False),
    "SELECT * FROM t WHERE event_date>=1": (True, {"event_date"}, False),
    "SELECT * FROM t": (False, set(), True),
    "SELECT * FROM t LIMIT 10": (False, set(), False),
    "SELECT * FROM t LIMIT 100": (False, set(), True),
    "WITH a AS (SELECT 1) SELECT * FROM a": (False, set(), False),
}


def test_partition_usage(spark):
    got = apply(spark, PARTITIONS, fn.partition_usage("q"))
    assert [(p.has_where, set(p.filters), p.likely_full_scan) for p in got] == list(PARTITIONS.values())


def test_texts_of_any_length(spark):
    """No rule overflows the matcher's stack or looks at a prefix only."""
    columns, tests = "col_a, " * 60_000, "x = 1 AND " * 20_000
    long = f"SELECT {columns} '{'q' * 100_000}' FROM raw.t WHERE {tests} dt = 1 -- {'c' * 50_000}\n /* {'d ' * 50_000} */ JOIN z"
    rows = spark.createDataFrame([(long,)], "query_string string")
    from loglens.operators.querylog import classify_log

    row = classify_log(rows).select(
        "features", "flags", "complexity.join_count", "partitions.filters",
        fn.extract_tables("query_string").alias("tables"),
        fn.query_fingerprint("query_string").alias("hash"),
        fn.sanitize_query("query_string").alias("masked"),
    ).first()
    assert (row.features, row.flags, row.join_count, row.filters) == ([], [], 1, ["dt"])
    assert row.tables == ["raw.t", "z"] and len(row.masked) == 1003
    form = f"SELECT {columns.upper().strip()} '?' FROM RAW.T WHERE {'X = ? AND ' * 20_000}DT = ? -- {'C' * 50_000} /* {'D ' * 50_000}*/ JOIN Z"
    assert row.hash == digest(form)
