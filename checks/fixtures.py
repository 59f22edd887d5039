"""Fixture views over the given tables, in SQL that both engines accept.

``{events}`` and ``{supplier}`` stand for the tables. Every view derives all of
its rows from them, so the work of every query grows with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglens.session import use_utc

ALLOWED = ("primary", "analytics", "etl", "adhoc")
LOCAL_ACCOUNT = "3"

_TEMPLATES = (
    "'SELECT * FROM raw.customers'",
    "'SELECT COUNT(*) FROM raw.sales WHERE id = ' || CAST(event_id AS STRING)",
    "'SELECT a.x, SUM(b.y) FROM raw.orders a LEFT JOIN raw.items b ON a.id = b.id JOIN raw.parts c ON b.p = c.p INNER JOIN raw.s d ON c.s = d.s WHERE a.dt >= ''2024-01-01'' GROUP BY a.x'",
    "'WITH t AS (SELECT id FROM curated.users) SELECT id, ROW_NUMBER() OVER (ORDER BY id) FROM t LIMIT 10'",
    "'CREATE TABLE curated.daily_' || CAST(user_id AS STRING) || ' AS SELECT * FROM raw.sales'",
    "'DROP TABLE IF EXISTS curated.daily_' || CAST(user_id AS STRING)",
    "'SELECT JSON_EXTRACT(payload, ''$.a'') FROM raw.logs WHERE country = ''DE'''",
    "'UNLOAD (SELECT * FROM raw.sales) TO ''s3://b/p/'''",
    "'SELECT APPROX_DISTINCT(u) FROM a.b.c.d CROSS JOIN UNNEST(tags) AS x(tag)'",
    "'select name from raw.customers where name = ''O''''Brien'' -- note'",
    "'SHOW TABLES'",
    "'ALTER TABLE raw.sales ADD PARTITION (dt = ''2024-01-02'')'",
    "'MERGE INTO curated.users u USING raw.updates r ON u.id = r.id'",
    "'SELECT region, SUM(v) FROM raw.sales WHERE year = 2024 GROUP BY ROLLUP (region)'",
    "'SELECT id FROM raw.events LIMIT 50'",
    "'SELECT id FROM (SELECT id FROM (SELECT id FROM (SELECT id FROM raw.deep)))'",
)
_ERRORS = (
    "Query timed out", "out of memory", "syntax error near x", "Access denied",
    "Table does not exist", "type mismatch", "Division by zero", "Limit reached",
    "Query was cancelled", "internal failure", "strange",
)


def _pick(value: str, choices) -> str:
    whens = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices))
    return f"CASE {value} {whens} END"


def _quoted(*words: str) -> list[str]:
    return [f"'{w}'" for w in words]


USAGE_ROW = f"""
SELECT event_id AS id,
  'e' || CAST(event_id AS STRING) AS event_id,
  'q' || CAST(event_id AS STRING) AS query_execution_id,
  ts AS event_time,
  CAST(user_id % 25 AS STRING) AS account_id,
  CASE WHEN event_id % 10 = 0 THEN 'arn:aws:sts::1:assumed-role/analyst/user' || CAST(user_id AS STRING)
       WHEN event_id % 97 = 0 THEN 'arn:aws:iam::1:root'
       ELSE 'arn:aws:iam::1:user/user' || CAST(user_id AS STRING) END AS user_arn,
  {_pick("user_id % 4", _quoted("primary", "analytics", "etl", "secret"))} AS workgroup,
  {_pick("user_id % 3", _quoted("raw", "curated", "default"))} AS db,
  {_pick("event_id % 16", _TEMPLATES)} AS query_string,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'CANCELLED' ELSE 'SUCCEEDED' END AS status,
  CASE WHEN event_type = 'error' THEN {_pick("event_id % 11", _quoted(*_ERRORS))} END AS error_message,
  CAST(FLOOR(value * 10000) AS BIGINT) AS execution_time_ms,
  CAST(FLOOR(value * 1048576) AS BIGINT) AS data_scanned_bytes
FROM {{events}}
"""

# A view may use the ones above it.
VIEWS = {
    "usage_row": USAGE_ROW,
    "usage_log": "SELECT * FROM usage_row UNION ALL SELECT * FROM usage_row WHERE id % 7 = 0",
    "execution_stats": """
SELECT query_execution_id,
  CASE WHEN id % 29 = 1 THEN '' ELSE query_string END AS query,
  CASE WHEN id % 13 = 0 THEN 'adhoc' WHEN id % 7 = 1 THEN NULL ELSE workgroup END AS workgroup,
  CASE WHEN db = 'default' THEN NULL ELSE db END AS database,
  status, data_scanned_bytes AS data_scanned, execution_time_ms
FROM usage_row WHERE id % 3 <> 0
UNION ALL
SELECT 'x' || CAST(id AS STRING), query_string, workgroup, db, status, data_scanned_bytes, execution_time_ms
FROM usage_row WHERE id % 500 = 0
""",
    "s3_log": f"""
SELECT event_id AS id, 's' || CAST(event_id AS STRING) AS event_id, ts AS event_time,
  CAST(user_id % 25 AS STRING) AS account_id,
  CASE event_type WHEN 'view' THEN 'GetObject' WHEN 'purchase' THEN 'PutObject'
    WHEN 'click' THEN 'ListObjectsV2' WHEN 'error' THEN 'HeadObject' ELSE 'DeleteObject' END AS event_name,
  {_pick("user_id % 5", _quoted("athena-results", "corp-datalake", "misc-logs", "raw-zone", "Analytics-wh"))} AS bucket,
  CASE WHEN event_id % 19 = 0 THEN '' ELSE 'data/' || CAST(user_id % 7 AS STRING) || '/f' || CAST(event_id AS STRING) || '.parquet' END AS object_key,
  'user' || CAST(user_id AS STRING) AS user_id,
  CASE WHEN event_id % 17 = 0 THEN 0 ELSE CAST(FLOOR(value * 1048576) AS BIGINT) END AS bytes_transferred,
  CASE WHEN event_id % 13 = 0 THEN CAST(FLOOR(value * 2097152) AS BIGINT) END AS object_size,
  CAST(FLOOR(value * 524288) AS BIGINT) AS extra_bytes_in,
  CAST(FLOOR(value * 262144) AS BIGINT) AS extra_bytes_out
FROM {{events}}
""",
    "accounts": """
SELECT CAST(s_suppkey AS STRING) AS account_id, s_name AS account_name,
  CASE WHEN s_nationkey % 5 = 4 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status
FROM {supplier}
""",
    "account_errors": """
SELECT CAST(s_suppkey AS STRING) AS account_id, 'Failed to assume role' AS error
FROM {supplier} WHERE s_suppkey % 9 = 8
""",
    # Audit records, flat: query starts, polls, store events, other services.
    "audit_flat": """
SELECT id, CASE WHEN id % 41 = 0 THEN '' ELSE event_id END AS event_id,
  'StartQueryExecution' AS event_name, 'athena.amazonaws.com' AS event_source,
  CASE WHEN id % 100 = 99 THEN 'not-a-time' ELSE REPLACE(CAST(event_time AS STRING), ' ', 'T') || 'Z' END AS event_time_text,
  CASE WHEN id % 31 = 0 THEN NULL ELSE user_arn END AS user_arn,
  CASE WHEN id % 62 = 0 THEN '' ELSE 'P' || account_id END AS principal_id,
  'eu-west-1' AS aws_region, '10.0.0.1' AS source_ip,
  CASE WHEN workgroup = 'primary' THEN NULL ELSE workgroup END AS workgroup,
  CASE WHEN id % 37 = 0 THEN NULL ELSE query_string END AS query_string,
  CASE WHEN db = 'default' THEN NULL ELSE db END AS db,
  CASE WHEN id % 53 = 0 THEN NULL ELSE query_execution_id END AS query_execution_id,
  CAST(NULL AS STRING) AS poll_workgroup, CAST(NULL AS BIGINT) AS poll_bytes,
  CAST(NULL AS STRING) AS bucket, CAST(NULL AS STRING) AS object_key,
  CASE WHEN status = 'FAILED' THEN 'AccessDenied' END AS error_code, account_id
FROM usage_log
UNION ALL
SELECT id, 'p' || CAST(id AS STRING) || '-' || poll, 'GetQueryExecution', 'athena.amazonaws.com',
  REPLACE(CAST(event_time AS STRING), ' ', 'T') || 'Z', user_arn, 'P' || account_id,
  'eu-west-1', '10.0.0.2', NULL, NULL, NULL, query_execution_id, workgroup, data_scanned_bytes,
  NULL, NULL, NULL, account_id
FROM (SELECT *, '1' AS poll FROM usage_row WHERE id % 5 = 0
      UNION ALL SELECT *, '2' AS poll FROM usage_row WHERE id % 10 = 0) polls
UNION ALL
SELECT id, event_id, event_name, 's3.amazonaws.com', REPLACE(CAST(event_time AS STRING), ' ', 'T') || 'Z',
  'arn:aws:iam::1:user/' || user_id, '', 'eu-west-1', '10.0.0.3', NULL, NULL, NULL, NULL, NULL, NULL,
  bucket, object_key, NULL, account_id
FROM s3_log
UNION ALL
SELECT id, 'n' || CAST(id AS STRING), CASE WHEN id % 20 = 3 THEN 'GetDatabase' ELSE 'ConsoleLogin' END,
  CASE WHEN id % 20 = 3 THEN 'glue.amazonaws.com' ELSE 'signin.amazonaws.com' END,
  REPLACE(CAST(event_time AS STRING), ' ', 'T') || 'Z', user_arn, '', 'eu-west-1', '10.0.0.4',
  NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, account_id
FROM usage_row WHERE id % 20 IN (3, 7)
""",
}


def _needed(name: str) -> list[str]:
    """The view and those it uses, in order of definition."""
    out: set[str] = set()

    def visit(view: str) -> None:
        if view in out:
            return
        out.add(view)
        for other in VIEWS:
            if other != view and re.search(rf"\b{other}\b", VIEWS[view]):
                visit(other)

    visit(name)
    return [v for v in VIEWS if v in out]


def with_views(*names: str) -> str:
    """``name AS (...)`` parts for a WITH clause in the check engine."""
    wanted = {v for name in names for v in _needed(name)}
    parts = [
        f"{v} AS ({VIEWS[v].replace('{events}', 'events').replace('{supplier}', 'supplier').strip()})"
        for v in VIEWS
        if v in wanted
    ]
    return ",\n".join(parts)


def view(spark: SparkSession, sf_dir: str, name: str, events: DataFrame | None = None) -> DataFrame:
    """A fixture view as a DataFrame; ``events`` may be a stream."""
    use_utc(spark)
    wanted = _needed(name)
    tables = {}
    text = "\n".join(VIEWS[v] for v in wanted)
    if "{events}" in text:
        tables["events"] = (
            spark.read.parquet(f"{sf_dir}/events.parquet") if events is None else events
        )
    if "{supplier}" in text:
        tables["supplier"] = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    parts = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in wanted)
    return spark.sql(f"WITH {parts} SELECT * FROM {name}", **tables)


def raw_audit(spark: SparkSession, sf_dir: str, *kept: str) -> DataFrame:
    """The flat audit rows wrapped back into audit records."""
    flat = view(spark, sf_dir, "audit_flat")
    c = F.col
    request = F.struct(
        c("workgroup").alias("workGroup"),
        c("query_string").alias("queryString"),
        F.when(c("event_name") == "GetQueryExecution", c("query_execution_id")).alias("queryExecutionId"),
        F.struct(c("db").alias("database")).alias("queryExecutionContext"),
        c("bucket").alias("bucketName"),
        c("object_key").alias("key"),
    )
    start = c("event_name") == "StartQueryExecution"
    response = F.struct(
        F.when(start, c("query_execution_id")).alias("queryExecutionId"),
        F.when(
            c("poll_workgroup").isNotNull(),
            F.struct(
                c("poll_workgroup").alias("workGroup"),
                F.struct(c("poll_bytes").alias("dataScannedInBytes")).alias("statistics"),
            ),
        ).alias("queryExecution"),
    )
    return flat.select(
        c("event_id").alias("eventID"),
        c("event_name").alias("eventName"),
        c("event_source").alias("eventSource"),
        c("event_time_text").alias("eventTime"),
        F.struct(c("user_arn").alias("arn"), c("principal_id").alias("principalId")).alias("userIdentity"),
        c("aws_region").alias("awsRegion"),
        c("source_ip").alias("sourceIPAddress"),
        F.to_json(request).alias("requestParameters"),
        F.to_json(response).alias("responseElements"),
        F.lit(None).cast("string").alias("additionalEventData"),
        c("error_code").alias("errorCode"),
        c("account_id").alias("recipientAccountId"),
        *kept,
    )
