"""The same results in SQL for the check engine, written apart from the library."""

from __future__ import annotations

from loglens import rules

from .fixtures import ALLOWED, LOCAL_ACCOUNT, with_views

ORACLE: dict[str, str] = {}


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def time_text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


USER = """CASE WHEN user_arn IS NOT NULL AND user_arn NOT IN ('', 'unknown')
  THEN CASE WHEN contains(user_arn, '/') THEN split_part(user_arn, '/', -1) ELSE split_part(user_arn, ':', -1) END
  ELSE coalesce(nullif({principal}, ''), 'unknown') END"""

QUERY_TYPE = """CASE WHEN starts_with(u, 'SELECT') THEN CASE WHEN contains(u, ' AS SELECT') THEN 'CTAS' ELSE 'SELECT' END
  WHEN starts_with(u, 'CREATE TABLE') THEN 'CREATE_TABLE' WHEN starts_with(u, 'CREATE VIEW') THEN 'CREATE_VIEW'
  WHEN starts_with(u, 'DROP') THEN 'DROP' WHEN starts_with(u, 'ALTER') THEN 'ALTER'
  WHEN starts_with(u, 'INSERT') THEN 'INSERT' WHEN starts_with(u, 'SHOW') THEN 'SHOW'
  WHEN starts_with(u, 'DESCRIBE') THEN 'DESCRIBE' WHEN starts_with(u, 'MSCK') THEN 'MSCK_REPAIR'
  WHEN starts_with(u, 'UNLOAD') THEN 'UNLOAD' ELSE 'OTHER' END"""


def query_type(column: str) -> str:
    return QUERY_TYPE.replace("(u,", f"(upper(trim({column})),")


def fingerprint(column: str) -> str:
    text = f"upper(trim({column}))"
    text = f"regexp_replace({text}, '''[^'']*''', '''?''', 'g')"
    text = rf"regexp_replace({text}, '\b\d+\.?\d*\b', '?', 'g')"
    text = rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
    return f"left(sha256({text}), 12)"


def sanitized(column: str) -> str:
    text = rf"regexp_replace({column}, '--[^\n]*', '', 'g')"
    text = rf"regexp_replace({text}, '(?s)/\*.*?\*/', '', 'g')"
    text = rf"regexp_replace({text}, '''(?:[^''\\]|\\.)*''', '''<VALUE>''', 'g')"
    text = rf"""regexp_replace({text}, '"(?:[^"\\]|\\.)*"', '"<VALUE>"', 'g')"""
    text = rf"regexp_replace({text}, '\b\d+\.?\d*\b', '<NUM>', 'g')"
    return f"CASE WHEN length({text}) > 1000 THEN left({text}, 1000) || '...' ELSE {text} END"


def tables(column: str) -> str:
    parts = [
        rf"regexp_extract_all({column}, '\b{word}\s+{rules.TABLE_NAME}', 1, 'i')"
        for word in ("FROM", "JOIN")
    ]
    found = f"list_distinct(list_concat({', '.join(parts)}))"
    return f"list_filter({found}, lambda t: lower(t) NOT IN {_in(rules.NOT_TABLES)})"


def joined(list_sql: str) -> str:
    return f"array_to_string(list_sort({list_sql}), ',')"


def _tag_list(rule_rows, column: str) -> str:
    """Matching tags as a list; only the patterns are shared with the library."""
    hits: dict[str, list[str]] = {}
    for rule in rule_rows:
        text = column if rule.raw else f"upper({column})"
        hits.setdefault(rule.tag, []).append(f"regexp_matches({text}, {_text(rule.pattern)})")
    cases = ", ".join(f"CASE WHEN {' OR '.join(t)} THEN {_text(tag)} END" for tag, t in hits.items())
    return f"list_filter([{cases}], lambda t: t IS NOT NULL)"


def _n(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {_text(pattern)}))"


BUCKET_RULE = f"regexp_matches(lower(bucket), '{'|'.join(rules.BUCKET_WORDS)}')"

ERROR_CLASS = """CASE
  WHEN contains(m, 'timeout') OR contains(m, 'timed out') THEN 'Timeout'
  WHEN contains(m, 'memory') OR contains(m, 'oom') THEN 'Memory Exceeded'
  WHEN contains(m, 'syntax') OR contains(m, 'parse') THEN 'Syntax Error'
  WHEN contains(m, 'permission') OR contains(m, 'access denied') OR contains(m, 'not authorized') THEN 'Permission Denied'
  WHEN contains(m, 'does not exist') OR contains(m, 'not found') THEN 'Resource Not Found'
  WHEN contains(m, 'type') AND (contains(m, 'mismatch') OR contains(m, 'cannot be')) THEN 'Type Error'
  WHEN contains(m, 'division by zero') THEN 'Division By Zero'
  WHEN contains(m, 'limit') THEN 'Limit Exceeded'
  WHEN contains(m, 'cancelled') OR contains(m, 'canceled') THEN 'Query Cancelled'
  WHEN contains(m, 'internal') THEN 'Internal Error' ELSE 'Other Error' END""".replace(
    "(m,", "(lower(coalesce(error_message, '')),"
)

TIME_BUCKET = """CASE WHEN execution_time_ms < 1000 THEN '< 1 second' WHEN execution_time_ms < 5000 THEN '1-5 seconds'
  WHEN execution_time_ms < 30000 THEN '5-30 seconds' WHEN execution_time_ms < 60000 THEN '30s - 1 minute'
  WHEN execution_time_ms < 300000 THEN '1-5 minutes' WHEN execution_time_ms < 600000 THEN '5-10 minutes'
  ELSE '> 10 minutes' END"""


def bytes_text(column: str) -> str:
    cases = " ".join(
        f"WHEN {column} < {1024 ** (i + 1)} THEN printf('%.1f {unit}', {column} / {float(1024**i)!r})"
        for i, unit in enumerate(("B", "KB", "MB", "GB", "TB"))
    )
    return f"CASE WHEN {column} = 0 THEN '0 B' {cases} ELSE printf('%.1f PB', {column} / {float(1024**5)!r}) END"


# --- shared parts ---

PARTS = {
    # The query log, first row per id.
    "qlog": f"""SELECT *, {USER.format(principal="''")} AS user_id, query_execution_id AS query_id,
  data_scanned_bytes AS data_scanned
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY event_time) AS rn FROM usage_log) WHERE rn = 1""",
    "tagged": f"""SELECT *, {_tag_list(rules.FEATURE_RULES, "query_string")} AS features,
  {_tag_list(rules.FLAG_RULES, "query_string")} AS flags FROM qlog""",
    # Fixture texts have one blank before JOIN, so qualified joins can be
    # removed before the bare ones are counted.
    "complexity": rf"""SELECT *,
  {_n("u", r"\bLEFT\s+OUTER\s+JOIN\b")} AS j_lo, {_n("u", r"\bRIGHT\s+OUTER\s+JOIN\b")} AS j_ro,
  {_n("u", r"\bFULL\s+OUTER\s+JOIN\b")} AS j_fo, {_n("u", r"\bLEFT\s+JOIN\b")} AS j_l,
  {_n("u", r"\bRIGHT\s+JOIN\b")} AS j_r, {_n("u", r"\bINNER\s+JOIN\b")} AS j_i, {_n("u", r"\bCROSS\s+JOIN\b")} AS j_c,
  len(regexp_extract_all(regexp_replace(u, '\b(LEFT|RIGHT|INNER|CROSS|OUTER|FULL) JOIN\b', '', 'g'), '\bJOIN\b')) AS j_b,
  {_n("u", r"\bWITH\s+\w+\s+AS\s*\(")} AS cte_count, {_n("u", r"\(\s*SELECT\b")} AS subquery_count,
  {_n("u", r"\bUNION\s+(?:ALL\s+)?")} AS union_count, regexp_matches(u, '\bGROUP\s+BY\b') AS has_group_by,
  regexp_matches(u, '\b(COUNT|SUM|AVG|MIN|MAX|ARRAY_AGG|STRING_AGG)\s*\(') AS has_aggregation,
  contains(u, 'SELECT ') AND NOT regexp_matches(u, 'COUNT\s*\(\s*\*\s*\)\s*$') AS ungrouped
FROM (SELECT *, upper(query_string) AS u FROM qlog)""",
    "complex": """SELECT *, j_lo + j_ro + j_fo + j_l + j_r + j_i + j_c + j_b AS join_count FROM complexity""",
    "ddl": r"""SELECT *, CASE WHEN ddl_type IS NOT NULL THEN
   coalesce(nullif(replace(replace(replace(regexp_extract(u, '(TABLE|VIEW)\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?([`"'']?\w+[`"'']?\.)?([`"'']?\w+[`"'']?)', 3), '"', ''), '''', ''), '`', ''), ''), 'unknown') END AS object,
   hour(event_time) AS hour
FROM (SELECT *, CASE WHEN regexp_matches(u, '^CREATE\s+(OR\s+REPLACE\s+)?(EXTERNAL\s+)?(TABLE|VIEW|SCHEMA|DATABASE)') THEN 'CREATE'
   WHEN regexp_matches(u, '^DROP\s+(TABLE|VIEW|SCHEMA|DATABASE)') THEN 'DROP'
   WHEN regexp_matches(u, '^ALTER\s+(TABLE|VIEW|SCHEMA|DATABASE)') THEN 'ALTER'
   WHEN regexp_matches(u, '^TRUNCATE\s+TABLE') THEN 'TRUNCATE'
   WHEN regexp_matches(u, '^MSCK\s+REPAIR\s+TABLE') THEN 'REPAIR' END AS ddl_type
 FROM (SELECT *, upper(trim(query_string)) AS u FROM qlog)) WHERE ddl_type IS NOT NULL""",
    "parted": f"""SELECT *, list_filter([{", ".join(
        f"CASE WHEN regexp_matches(u, '\\bWHERE\\b.*\\b{c.upper()}\\s*[=<>]') THEN '{c}' END" for c in rules.PARTITION_COLUMNS
    )}], lambda t: t IS NOT NULL) AS filters, regexp_matches(u, '\\bWHERE\\b') AS has_where,
  regexp_matches(u, '^\\s*SELECT\\b') AND NOT regexp_matches(u, '\\bWHERE\\b')
    AND NOT regexp_matches(u, '\\bLIMIT\\s+[1-9]\\d{{0,1}}\\b') AS likely_full_scan
FROM (SELECT *, upper(query_string) AS u FROM qlog)""",
    "store_ops": """SELECT *, CASE WHEN contains(event_name, 'Get') THEN 'get' WHEN contains(event_name, 'Put') THEN 'put'
   WHEN contains(event_name, 'List') THEN 'list' END AS operation,
  CASE WHEN contains(event_name, 'Get') THEN coalesce(nullif(bytes_transferred, 0), extra_bytes_out, 0) ELSE 0 END AS bytes_out,
  CASE WHEN contains(event_name, 'Put') THEN coalesce(nullif(bytes_transferred, 0), extra_bytes_in, 0) ELSE 0 END AS bytes_in
FROM s3_log WHERE bucket <> ''""",
    "sizes": """SELECT * FROM (SELECT coalesce(nullif(object_size, 0), nullif(bytes_out, 0), nullif(bytes_in, 0), 0) AS size
FROM store_ops WHERE operation IN ('get', 'put')) WHERE size > 0""",
    "buckets": """SELECT bucket, count(*) FILTER (operation = 'get') AS get_count, count(*) FILTER (operation = 'put') AS put_count,
  count(*) FILTER (operation = 'list') AS list_count,
  count(DISTINCT CASE WHEN object_key <> '' THEN split_part(object_key, '/', 1) || '/' || split_part(object_key, '/', 2) END) AS unique_prefixes,
  count(DISTINCT user_id) AS unique_users FROM store_ops GROUP BY bucket""",
    # The audit log.
    "routed": f"""SELECT *, CASE WHEN event_source = 'athena.amazonaws.com' OR event_name IN {_in(rules.QUERY_EVENT_NAMES)} THEN 'query'
  WHEN event_source = 's3.amazonaws.com' AND event_name IN {_in(rules.STORE_EVENT_NAMES)} THEN 'store' END AS route
FROM audit_flat""",
    "aq": f"""SELECT event_id, event_name,
  try_cast(replace(replace(event_time_text, 'T', ' '), 'Z', '') AS TIMESTAMP) AS event_time,
  {USER.format(principal="principal_id")} AS user_id, coalesce(user_arn, 'unknown') AS user_arn, aws_region, source_ip,
  coalesce(workgroup, 'primary') AS workgroup, coalesce(db, 'default') AS database, query_string, query_execution_id,
  poll_workgroup AS polled_workgroup, poll_bytes AS polled_bytes, error_code, account_id
FROM routed WHERE route = 'query'""",
    "adedup": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY event_time) AS rn FROM aq)
WHERE rn = 1 OR event_id = ''""",
    "aev": f"SELECT * FROM adedup WHERE workgroup IN {_in(ALLOWED)}",
    "ast": """SELECT * FROM (SELECT query_execution_id, event_time, event_id, user_id, account_id, query_string, workgroup, database,
  row_number() OVER (PARTITION BY query_execution_id ORDER BY event_time DESC, event_id DESC) AS rn
FROM aev WHERE event_name = 'StartQueryExecution' AND coalesce(query_execution_id, '') <> '') WHERE rn = 1""",
    "stats": """SELECT query_execution_id, query, coalesce(workgroup, 'primary') AS workgroup, coalesce(database, 'default') AS database,
  status, data_scanned, execution_time_ms FROM execution_stats WHERE query <> ''""",
    "enriched": """SELECT a.query_execution_id, a.event_time, a.event_id, a.user_id, a.account_id,
  CASE WHEN s.query IS NOT NULL THEN s.query ELSE a.query_string END AS query,
  CASE WHEN s.query IS NOT NULL THEN s.workgroup WHEN a.query_string IS NOT NULL THEN a.workgroup END AS workgroup,
  CASE WHEN s.query IS NOT NULL THEN s.database WHEN a.query_string IS NOT NULL THEN a.database END AS database,
  CASE WHEN s.query IS NOT NULL THEN s.status ELSE '' END AS status,
  CASE WHEN s.query IS NOT NULL THEN s.data_scanned ELSE 0 END AS data_scanned,
  CASE WHEN s.query IS NOT NULL THEN s.execution_time_ms ELSE 0 END AS execution_time_ms
FROM ast a LEFT JOIN stats s ON a.query_execution_id = s.query_execution_id""",
    "facts": f"""SELECT *, {query_type("query")} AS query_type, {fingerprint("query")} AS pattern_hash
FROM enriched WHERE query <> ''""",
    "wg": """SELECT workgroup, count(*) AS query_count, count(DISTINCT user_id) AS unique_users,
  CAST(sum(data_scanned) AS BIGINT) AS total_data_scanned FROM facts GROUP BY workgroup""",
    "types": "SELECT query_type, count(*) AS query_count FROM facts GROUP BY query_type",
    "fact_tables": f"SELECT *, unnest({tables('query')}) AS table_name FROM facts",
    "dbs": """SELECT database, count(*) AS query_count,
  (SELECT count(DISTINCT table_name) FROM fact_tables t WHERE t.database = f.database) AS unique_tables,
  count(DISTINCT user_id) AS unique_users FROM facts f GROUP BY database""",
    "patterns": """SELECT f.pattern_hash, count(*) AS query_count, CAST(sum(data_scanned) AS BIGINT) AS total_data_scanned,
  CAST(sum(execution_time_ms) AS BIGINT) AS total_execution_time_ms, count(DISTINCT user_id) AS unique_users,
  count(DISTINCT workgroup) AS unique_workgroups, count(DISTINCT database) AS unique_databases,
  coalesce(any_value(t.n), 0) AS unique_tables, round(sum(execution_time_ms) / count(*), 6) AS avg_execution_time_ms
FROM facts f LEFT JOIN (SELECT pattern_hash, count(DISTINCT table_name) AS n FROM fact_tables GROUP BY 1) t ON t.pattern_hash = f.pattern_hash
GROUP BY f.pattern_hash""",
    "sev": f"""SELECT event_id, bucket, account_id, {USER.format(principal="coalesce(principal_id, '')")} AS user_id FROM routed WHERE route = 'store' AND {BUCKET_RULE}""",
    "acct": """SELECT account_id,
  coalesce(e.n, 0) AS total_athena_events, coalesce(s.n, 0) AS total_s3_events, coalesce(t.n, 0) AS query_execution_ids_found,
  coalesce(f.n, 0) AS queries_fetched_from_athena, coalesce(e.u, 0) AS unique_users, coalesce(f.w, 0) AS unique_workgroups,
  coalesce(f.d, 0) AS unique_databases, coalesce(f.p, 0) AS unique_query_patterns, coalesce(s.b, 0) AS unique_buckets
FROM (SELECT account_id, count(*) AS n, count(DISTINCT user_id) AS u FROM aev GROUP BY 1) e
FULL JOIN (SELECT account_id, count(*) AS n, count(DISTINCT bucket) AS b FROM sev GROUP BY 1) s USING (account_id)
FULL JOIN (SELECT account_id, count(*) AS n FROM ast GROUP BY 1) t USING (account_id)
FULL JOIN (SELECT account_id, count(*) AS n, count(DISTINCT workgroup) AS w, count(DISTINCT database) AS d, count(DISTINCT pattern_hash) AS p FROM facts GROUP BY 1) f USING (account_id)""",
    "coverage": """SELECT account_id, coalesce(total_athena_events, 0) AS total_athena_events,
  coalesce(queries_fetched_from_athena, 0) AS queries_fetched_from_athena, coalesce(unique_users, 0) AS unique_users,
  coalesce(unique_workgroups, 0) AS unique_workgroups, error,
  CASE WHEN error IS NOT NULL THEN error WHEN coalesce(total_athena_events, 0) = 0 THEN 'No events' ELSE 'OK' END AS status
FROM accounts LEFT JOIN acct USING (account_id) LEFT JOIN account_errors USING (account_id)""",
    "overview": f"""SELECT (SELECT count(*) FROM aev) AS total_athena_events, (SELECT count(*) FROM sev) AS total_s3_events,
  (SELECT count(*) FROM ast) AS query_execution_ids_found, (SELECT count(*) FROM facts) AS queries_fetched_from_athena,
  (SELECT count(DISTINCT user_id) FROM aev) AS unique_users, (SELECT count(DISTINCT workgroup) FROM facts) AS unique_workgroups,
  (SELECT count(DISTINCT database) FROM facts) AS unique_databases, (SELECT count(DISTINCT pattern_hash) FROM facts) AS unique_query_patterns,
  (SELECT count(DISTINCT bucket) FROM sev) AS unique_buckets,
  (SELECT count(DISTINCT workgroup) FROM aq WHERE workgroup NOT IN {_in(ALLOWED)}) AS skipped_workgroups_count,
  (SELECT count(DISTINCT bucket) FROM routed WHERE route = 'store' AND NOT {BUCKET_RULE}) AS skipped_buckets_count""",
    "counters": f"""SELECT (SELECT count(*) FROM qlog) AS events,
  (SELECT count(*) FROM qlog WHERE contains(upper(query_string), 'SELECT')) AS selects,
  (SELECT count(*) FROM complex WHERE join_count >= 3 OR subquery_count >= 3) AS high_complexity,
  (SELECT count(*) FROM complex WHERE cte_count > 0) AS with_cte,
  (SELECT count(*) FROM ddl) AS ddl_operations, (SELECT count(*) FROM ddl WHERE ddl_type = 'DROP') AS drops,
  (SELECT count(*) FROM qlog WHERE execution_time_ms >= 3600000) AS over_1h,
  (SELECT count(*) FROM qlog WHERE execution_time_ms >= 1800000) AS over_30m,
  (SELECT count(*) FROM qlog WHERE execution_time_ms >= 600000 AND execution_time_ms < 1800000) AS over_10m,
  (SELECT count(*) FROM parted WHERE likely_full_scan) AS full_scans,
  (SELECT count(*) FROM (SELECT unnest(flags) AS f FROM tagged) WHERE f IN ('GEOSPATIAL', 'FEDERATED_QUERY', 'UNLOAD')) AS risky,
  (SELECT count(*) FROM (SELECT unnest(flags) AS f FROM tagged)) AS all_flags,
  (SELECT count(*) FROM tagged WHERE list_contains(flags, 'GEOSPATIAL')) AS geo,
  (SELECT count(*) FROM tagged WHERE list_contains(flags, 'FEDERATED_QUERY')) AS federated,
  (SELECT avg(size) FROM sizes) AS mean_size""",
}
_FIXTURES = ("usage_row", "usage_log", "execution_stats", "s3_log", "accounts", "account_errors", "audit_flat")


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b{name}\b", text) is not None


def sql(name: str, body: str) -> None:
    """Registers a check: the fixture views and shared parts it names, then the body."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for part, definition in PARTS.items():
            if part not in needed and definition is not text and _mentions(text, part):
                needed.append(part)
                visit(definition)

    visit(body)
    parts = [p for p in PARTS if p in needed]
    everything = body + "\n".join(PARTS[p] for p in parts)
    fixtures = [f for f in _FIXTURES if _mentions(everything, f)]
    ctes = [with_views(*fixtures)] if fixtures else []
    ctes += [f"{p} AS ({PARTS[p]})" for p in parts]
    ORACLE[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


# --- sources and sinks ---

_AUDIT = """SELECT event_id AS "eventID", event_name AS "eventName", event_source AS "eventSource",
  event_time_text AS "eventTime", error_code AS "errorCode", user_arn AS "userArn"{extra} FROM audit_flat{where}"""
sql("read_audit_files", _AUDIT.format(extra="", where=""))
sql("audit_date_prefixes", _AUDIT.format(extra="", where=" WHERE left(event_time_text, 10) BETWEEN '2024-01-05' AND '2024-01-20'"))
PARTS["trail_days"] = """SELECT account_id, day, replace(day, '-', '/') AS folder FROM (SELECT DISTINCT account_id,
  coalesce(nullif(regexp_extract(event_time_text, '^\\d{4}-\\d\\d-\\d\\d'), ''), '2024-02-29') AS day FROM audit_flat)"""
_TRAIL = """
UNION ALL SELECT folder || '/large.json.gz', NULL, NULL, NULL, NULL, NULL, 'too large', account_id FROM trail_days WHERE CAST(account_id AS INT) % 5 = 1{where}
UNION ALL SELECT folder || '/broken.json.gz', NULL, NULL, NULL, NULL, NULL, 'unreadable', account_id FROM trail_days WHERE CAST(account_id AS INT) % 5 = 2{where}"""
_TAGS = ", '' AS problem, account_id"
_SHORT = " AND day BETWEEN '2024-01-05' AND '2024-01-20'"
sql("audit_file_size_filter", _AUDIT.format(extra=_TAGS, where="") + _TRAIL.format(where=""))
sql("audit_org_prefixes", _AUDIT.format(extra=_TAGS, where=" WHERE left(event_time_text, 10) BETWEEN '2024-01-05' AND '2024-01-20'") + _TRAIL.format(where=_SHORT))
sql("unwrap_api_record", """SELECT event_id AS "eventID", event_name AS "eventName", event_source AS "eventSource",
  event_time_text AS "eventTime", user_arn AS "userArn", query_string AS "queryString" FROM audit_flat""")
sql("land_records", f"""SELECT route, event_id, event_name, account_id, strftime(CAST(try_cast(replace(replace(event_time_text, 'T', ' '), 'Z', '') AS TIMESTAMP) AS DATE), '%Y-%m-%d') AS event_date,
  {USER.format(principal="coalesce(principal_id, '')")} AS user_id, coalesce(bucket, '') AS bucket, query_string
FROM routed WHERE route IS NOT NULL""")
PARTS["bundle_days"] = """SELECT account_id, strftime(event_time, '%Y%m%d') AS day, count(*) FILTER (WHERE kind = 'athena') AS n
FROM (SELECT account_id, event_time, 'athena' AS kind FROM usage_row UNION ALL SELECT account_id, event_time, 's3' FROM s3_log) GROUP BY ALL"""
sql("read_export_bundles", """SELECT 'athena' AS kind, event_id AS id, concat_ws('|', workgroup, status, query_string) AS detail FROM usage_row
UNION ALL SELECT 's3', event_id, concat_ws('|', event_name, bucket, object_key, bytes_transferred, extra_bytes_in, extra_bytes_out) FROM s3_log
UNION ALL SELECT 'summary', account_id || '-' || day || '.zip', CAST(n AS VARCHAR) FROM bundle_days
UNION ALL SELECT 'account', account_id || '-' || day || '.zip', concat_ws('|', 'member', account_id, n) FROM bundle_days
UNION ALL SELECT 'account', account_id || '-' || day || '.zip', concat_ws('|', 'summary', account_id, n) FROM bundle_days WHERE CAST(day AS INT) % 2 = 1
UNION ALL SELECT 'error', account_id || '-' || day || '-bad.zip', '' FROM bundle_days WHERE CAST(account_id AS INT) % 6 = 1
UNION ALL SELECT 'error', account_id || '-' || day || '-cut.zip', '' FROM bundle_days WHERE CAST(account_id AS INT) % 6 = 2""")
sql("read_execution_stats", "SELECT * FROM stats")
sql("write_workgroup_csv", "SELECT workgroup, query_count, unique_users, printf('%.4f', total_data_scanned / 1073741824.0) AS data_scanned_gb FROM wg")
sql("write_event_tables", """SELECT coalesce(strftime(event_time, '%Y-%m-%d'), NULL) AS event_date, count(*) AS event_count
FROM aev GROUP BY 1""")
sql("workgroup_report_lines", r"""SELECT 'Workgroup: ' || workgroup || chr(10) || '  Queries: ' || query_count || chr(10) || '  Users: ' || unique_users
  || chr(10) || '  Data Scanned: ' || printf('%.2f', total_data_scanned / 1073741824.0) || ' GB' || chr(10) || '  Query Types: {' || t.types || '}' AS line
FROM wg JOIN (SELECT workgroup, string_agg('''' || query_type || ''': ' || n, ', ' ORDER BY query_type) AS types
  FROM (SELECT workgroup, query_type, count(*) AS n FROM facts GROUP BY ALL) GROUP BY workgroup) t USING (workgroup)""")
sql("metric_log_lines", """SELECT '{"type":"SUMMARY","data":' || to_json(o) || '}' AS line FROM overview o
UNION ALL SELECT '{"type":"WORKGROUP","workgroup":"' || workgroup || '","query_count":' || query_count || ',"unique_users":' || unique_users || '}' FROM wg""")
sql("write_summary_tables", f"""SELECT 'overview' AS section, 1 AS row_count
UNION ALL SELECT 'analysis_period', 1
UNION ALL SELECT 'configuration', {len(ALLOWED) + 2}
UNION ALL SELECT 'errors', 0
UNION ALL SELECT 'workgroup_stats', count(*) FROM wg
UNION ALL SELECT 'workgroup_query_types', count(*) FROM (SELECT DISTINCT workgroup, query_type FROM facts)
UNION ALL SELECT 'user_stats', count(DISTINCT user_id) FROM aev
UNION ALL SELECT 'user_scope', count(*) FROM (SELECT DISTINCT user_id, workgroup AS m, 'w' FROM facts UNION ALL SELECT DISTINCT user_id, database, 'd' FROM facts)
UNION ALL SELECT 'database_stats', count(*) FROM dbs
UNION ALL SELECT 'query_patterns', count(*) FROM patterns
UNION ALL SELECT 'pattern_examples', CAST(sum(n) AS BIGINT) FROM (SELECT least(count(DISTINCT {sanitized("query")}), 5) AS n FROM facts GROUP BY pattern_hash)
UNION ALL SELECT 's3_bucket_stats', count(DISTINCT bucket) FROM sev
UNION ALL SELECT 'hourly_query_counts', count(DISTINCT date_trunc('hour', event_time)) FROM aev
UNION ALL SELECT 'skipped_workgroups', skipped_workgroups_count FROM overview
UNION ALL SELECT 'skipped_buckets', skipped_buckets_count FROM overview""")

# --- filters ---

sql("route_events", 'SELECT event_id AS "eventID", event_name AS "eventName", route FROM routed WHERE route IS NOT NULL')
sql("workgroup_allow_list", f"SELECT event_id, event_name, workgroup FROM aq WHERE workgroup IN {_in(ALLOWED)}")
sql("skipped_workgroups", f"SELECT DISTINCT workgroup FROM aq WHERE workgroup NOT IN {_in(ALLOWED)}")
sql("bucket_filter", f"SELECT event_id, bucket FROM s3_log WHERE {BUCKET_RULE}")
sql("skipped_buckets", f"SELECT DISTINCT bucket FROM s3_log WHERE NOT {BUCKET_RULE} AND bucket <> ''")
sql("time_range_filter", f"""SELECT event_id, {time_text("event_time")} AS event_time FROM usage_log
WHERE event_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""")
sql("active_member_accounts", f"SELECT * FROM accounts WHERE status = 'ACTIVE' AND account_id <> '{LOCAL_ACCOUNT}'")
sql("exclude_local_account", f"SELECT * FROM accounts WHERE account_id <> '{LOCAL_ACCOUNT}'")
sql("valid_account_ids", """SELECT account_id, length(account_id) = 12 AND NOT starts_with(account_id, 'x') AS valid FROM (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS account_id FROM supplier WHERE s_suppkey % 4 IN (0, 1, 3)
  UNION ALL SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 4 = 0
  UNION ALL SELECT 'x' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') FROM supplier WHERE s_suppkey % 4 = 1)
WHERE account_id <> '000000000007'""")
sql("positive_measures", "SELECT event_id, execution_time_ms FROM qlog WHERE execution_time_ms > 0")

# --- projections ---

sql("normalize_athena_events", f"""SELECT * REPLACE ({time_text("event_time")} AS event_time) FROM aq""")
sql("normalize_s3_events", f"""SELECT event_id, event_name,
  {time_text("try_cast(replace(replace(event_time_text, 'T', ' '), 'Z', '') AS TIMESTAMP)")} AS event_time, bucket, object_key AS key,
  split_part(user_arn, '/', -1) AS user_id, account_id FROM routed WHERE route = 'store'""")
sql("user_id", f"SELECT event_id, event_name, {USER.format(principal='principal_id')} AS user_id FROM audit_flat")
sql("query_database", "SELECT event_id, coalesce(db, 'default') AS database FROM audit_flat WHERE event_name = 'StartQueryExecution'")
sql("classify_query", f"SELECT event_id, {query_type('query_string')} AS query_type FROM qlog")
sql("extract_tables", f"SELECT event_id, {joined(tables('query_string'))} AS tables FROM qlog")
sql("table_references", "SELECT query_execution_id, table_name FROM fact_tables")
sql("query_fingerprint", f"SELECT event_id, {fingerprint('query_string')} AS pattern_hash FROM qlog")
sql("sanitize_query", f"SELECT event_id, {sanitized('query_string')} AS text FROM qlog")
sql("object_prefix", "SELECT event_id, CASE WHEN object_key <> '' THEN split_part(object_key, '/', 1) || '/' || split_part(object_key, '/', 2) END AS prefix FROM s3_log")
sql("s3_operation", """SELECT event_id, CASE WHEN contains(event_name, 'Get') THEN 'get' WHEN contains(event_name, 'Put') THEN 'put'
  WHEN contains(event_name, 'List') THEN 'list' END AS operation FROM s3_log""")
sql("hour_key", "SELECT event_id, strftime(event_time, '%Y-%m-%dT%H') AS hour FROM qlog")
sql("day_key", "SELECT event_id, strftime(event_time, '%Y-%m-%d') AS day FROM qlog")
sql("minute_key", "SELECT event_id, strftime(event_time, '%Y-%m-%d %H:%M') AS minute FROM qlog")
sql("parse_event_time", f"""SELECT event_id, event_name,
  {time_text("try_cast(replace(replace(event_time_text, 'T', ' '), 'Z', '') AS TIMESTAMP)")} AS event_time FROM audit_flat""")
sql("sql_features", f"SELECT event_id, {joined('features')} AS features FROM tagged")
sql("query_complexity", """SELECT event_id, join_count, cte_count, subquery_count, union_count, has_group_by, has_aggregation,
  has_aggregation AND NOT has_group_by AND ungrouped AS potential_missing_group_by FROM complex""")
sql("ddl_operation", "SELECT event_id, ddl_type, object, hour FROM ddl")
sql("partition_usage", f"SELECT event_id, has_where, {joined('filters')} AS filters, likely_full_scan FROM parted")
sql("long_running_class", """SELECT event_id, CASE WHEN execution_time_ms >= 3600000 THEN 'over_1h' WHEN execution_time_ms >= 1800000 THEN 'over_30m'
  ELSE 'over_10m' END AS long_class, round_even(execution_time_ms / 60000, 1) AS execution_time_min, left(query_string, 500) AS query_preview
FROM qlog WHERE execution_time_ms >= 600000""")
sql("migration_flags", f"SELECT event_id, {joined('flags')} AS flags FROM tagged")
sql("error_class", f"SELECT event_id, {ERROR_CLASS} AS error_type FROM qlog WHERE status = 'FAILED'")
sql("execution_time_bucket", f"SELECT event_id, {TIME_BUCKET} AS bucket FROM qlog")
sql("format_bytes", f"SELECT event_id, {bytes_text('data_scanned')} AS size FROM qlog")
sql("pct_of_total", "SELECT query_type, query_count, round(query_count * 100.0 / (SELECT sum(query_count) FROM types), 6) AS pct FROM types")
sql("truncate_preview", """SELECT event_id, CASE WHEN length(query_string) > 50 THEN left(query_string, 50) || '...' ELSE query_string END AS preview,
  left(query_string, 30) AS head FROM qlog""")
_TAGS = "SELECT feature, count(*) AS query_count FROM (SELECT unnest(features) AS feature FROM tagged) GROUP BY feature"
_NOTES = " ".join(f"WHEN feature = {_text(k)} THEN {_text(v)}" for k, v in rules.FEATURE_NOTES.items())
sql("feature_notes", f"""SELECT *, CASE WHEN starts_with(feature, 'Trino:') THEN {_text(rules.DIALECT_NOTE)} {_NOTES} ELSE {_text(rules.DEFAULT_NOTE)} END AS note
FROM ({_TAGS} ORDER BY query_count DESC, feature LIMIT 15)""")

# --- deduplication and joins ---

sql("dedupe_events", f"SELECT event_id, event_name, {time_text('event_time')} AS event_time FROM adedup")
sql("query_starts", f"""SELECT query_execution_id, {time_text("event_time")} AS event_time, event_id, user_id, account_id, query_string,
  CASE WHEN query_string IS NOT NULL THEN workgroup END AS workgroup, CASE WHEN query_string IS NOT NULL THEN database END AS database FROM ast""")
sql("enrich_queries", f"SELECT * REPLACE ({time_text('event_time')} AS event_time) FROM enriched")
sql("query_facts", f"SELECT * REPLACE ({time_text('event_time')} AS event_time) FROM enriched WHERE query <> ''")
sql("stats_without_start", "SELECT * FROM stats WHERE query_execution_id NOT IN (SELECT query_execution_id FROM ast)")
sql("account_coverage", "SELECT account_id, total_athena_events, queries_fetched_from_athena, unique_users, unique_workgroups, status FROM coverage")
sql("prefer_non_empty", """SELECT event_id, query_string, query_execution_id AS query_id, workgroup, coalesce(error_message, '') AS error_message,
  data_scanned_bytes AS data_scanned FROM usage_log""")

# --- aggregates ---

sql("workgroup_stats", "SELECT * FROM wg")
sql("workgroup_query_types", "SELECT workgroup, query_type, count(*) AS query_count FROM facts GROUP BY ALL")
sql("polled_data_scanned", """SELECT workgroup, CAST(sum(b) AS BIGINT) AS polled_bytes FROM (SELECT query_execution_id, max(polled_workgroup) AS workgroup, max(polled_bytes) AS b
FROM aev WHERE event_name = 'GetQueryExecution' AND polled_bytes > 0 GROUP BY 1) GROUP BY 1""")
sql("user_activity", f"SELECT user_id, count(*) AS event_count, {time_text('max(event_time)')} AS last_activity FROM aev GROUP BY 1")
sql("user_scope", "SELECT user_id, count(DISTINCT workgroup) AS unique_workgroups, count(DISTINCT database) AS unique_databases FROM facts GROUP BY 1")
sql("user_first_last_seen", f"SELECT user_id, {time_text('min(event_time)')} AS first_seen, {time_text('max(event_time)')} AS last_seen FROM qlog GROUP BY 1")
sql("database_stats", "SELECT * FROM dbs")
sql("query_patterns", "SELECT * FROM patterns")
sql("pattern_examples", f"""SELECT * FROM (SELECT pattern_hash, example,
  row_number() OVER (PARTITION BY pattern_hash ORDER BY event_time NULLS FIRST, event_id, example) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY pattern_hash, example ORDER BY event_time NULLS FIRST, event_id) AS rn
  FROM (SELECT *, {sanitized("query")} AS example FROM facts)) WHERE rn = 1) WHERE rank <= 5""")
sql("s3_bucket_stats", "SELECT * FROM buckets")
sql("s3_bucket_bytes", "SELECT bucket, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(bytes_in) AS BIGINT) AS bytes_in FROM store_ops GROUP BY 1")
sql("s3_totals", """SELECT count(*) FILTER (operation IS NOT NULL) AS total_operations, CAST(sum(bytes_out) AS BIGINT) AS bytes_read,
  CAST(sum(bytes_in) AS BIGINT) AS bytes_written FROM store_ops""")
sql("object_size_stats", """SELECT count(*) AS object_count, round(avg(size), 6) AS avg_object_bytes, count(*) FILTER (size < 10485760) AS small_count,
  round(count(*) FILTER (size < 10485760) * 100.0 / count(*), 6) AS small_pct,
  CASE WHEN avg(size) < 10485760 THEN 'under 10 MiB' WHEN avg(size) < 52428800 THEN 'under 50 MiB' ELSE 'ok' END AS tier FROM sizes""")
sql("hourly_counts", "SELECT strftime(event_time, '%Y-%m-%dT%H') AS hour, count(*) AS event_count FROM aev WHERE event_time IS NOT NULL GROUP BY 1")
_DAYS = "SELECT strftime(event_time, '%Y-%m-%d') AS day, count(*) AS event_count FROM qlog GROUP BY 1"
sql("daily_counts", _DAYS)
_MINUTES = "SELECT strftime(event_time, '%Y-%m-%d %H:%M') AS minute, count(*) AS event_count FROM qlog GROUP BY 1"
sql("minute_concurrency", _MINUTES)
sql("peak_concurrency", f"SELECT max(event_count) AS peak_concurrency FROM ({_MINUTES})")
sql("query_type_counts", "SELECT * FROM types")
sql("sql_feature_counts", _TAGS)
sql("sql_feature_examples", """SELECT feature, rank, CASE WHEN length(query_string) > 300 THEN left(query_string, 300) || '...' ELSE query_string END AS example
FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY event_time, event_id) AS rank
  FROM (SELECT *, unnest(features) AS feature FROM tagged)) WHERE rank <= 2""")
_JOINS = """SELECT * FROM (SELECT unnest(['LEFT OUTER', 'RIGHT OUTER', 'FULL OUTER', 'LEFT', 'RIGHT', 'INNER', 'CROSS', 'JOIN']) AS join_type,
  unnest([sum(j_lo), sum(j_ro), sum(j_fo), sum(j_l), sum(j_r), sum(j_i), sum(j_c), sum(j_b)])::BIGINT AS join_count FROM complex) WHERE join_count > 0"""
sql("join_type_counts", _JOINS)
sql("join_types_ranked", _JOINS)
sql("complexity_totals", """SELECT count(*) FILTER (join_count >= 3 OR subquery_count >= 3) AS high_complexity,
  count(*) FILTER (join_count >= 2) AS multiple_joins, count(*) FILTER (cte_count > 0) AS with_cte FROM complex""")
_HIGH = "join_count >= 3 OR subquery_count >= 3"
# High-complexity fixture texts are template 2 (LEFT, INNER, JOIN) and 15 (none).
_HIGH_TYPES = "CASE WHEN join_count = 3 THEN '{three}' ELSE '{none}' END"
sql("high_complexity_queries", f"""SELECT {time_text("event_time")} AS event_time, event_id, query_id, join_count,
  {_HIGH_TYPES.format(three="INNER,JOIN,LEFT", none="")} AS join_types, cte_count, subquery_count, left(query_string, 500) AS query_preview
FROM complex WHERE {_HIGH}""")
sql("first_high_complexity", f"""SELECT query_id, join_count, {_HIGH_TYPES.format(three="LEFT, INNER, JOIN", none="N/A")} AS join_types, cte_count,
  subquery_count, left(query_string, 500) AS query_preview, greatest((SELECT count(*) FROM complex WHERE {_HIGH}) - 10, 0) AS more_queries
FROM complex WHERE {_HIGH} ORDER BY event_time, event_id LIMIT 10""")
sql("ddl_by_type", "SELECT ddl_type, count(*) AS ddl_count FROM ddl GROUP BY 1")
sql("ddl_by_hour", "SELECT hour, count(*) AS ddl_count FROM ddl GROUP BY 1")
sql("ddl_by_user", "SELECT user_id, ddl_type, count(*) AS ddl_count FROM ddl GROUP BY 1, 2")
sql("ddl_by_table", "SELECT object AS table_name, count(*) AS ddl_count FROM ddl GROUP BY 1")
sql("ddl_samples_by_type", """SELECT ddl_type, rank, user_id, query_string, greatest(n - 10, 0) AS more_queries FROM (
  SELECT *, row_number() OVER (PARTITION BY ddl_type ORDER BY event_time, event_id) AS rank, count(*) OVER (PARTITION BY ddl_type) AS n
  FROM ddl WHERE ddl_type IN ('DROP', 'CREATE', 'ALTER', 'TRUNCATE')) WHERE rank <= 10""")
sql("top_ddl_users", """SELECT user_id, count(*) FILTER (ddl_type = 'CREATE') AS create_count, count(*) FILTER (ddl_type = 'DROP') AS drop_count,
  count(*) FILTER (ddl_type = 'ALTER') AS alter_count, count(*) AS total_count FROM ddl GROUP BY 1 ORDER BY total_count DESC, user_id LIMIT 10""")
sql("partition_column_counts", "SELECT column_name, count(*) AS query_count FROM (SELECT unnest(filters) AS column_name FROM parted) GROUP BY 1")
sql("partition_filter_totals", """SELECT count(*) FILTER (len(filters) > 0) AS using_filter, count(*) FILTER (has_where AND len(filters) = 0) AS missing_filter,
  count(*) FILTER (likely_full_scan) AS full_scans FROM parted""")
sql("status_counts", """SELECT status, count(*) AS query_count, round(count(*) * 100.0 / (SELECT count(*) FROM qlog WHERE status <> ''), 6) AS pct
FROM qlog WHERE status <> '' GROUP BY 1""")
sql("failure_rate", """SELECT count(*) FILTER (status = 'SUCCEEDED') AS succeeded, count(*) FILTER (status = 'FAILED') AS failed, count(*) AS total,
  round(count(*) FILTER (status = 'FAILED') * 100.0 / count(*), 6) AS failure_rate FROM qlog WHERE status <> ''""")
_FAILED = f"SELECT *, {ERROR_CLASS} AS error_type FROM qlog WHERE status = 'FAILED'"
sql("error_type_counts", f"SELECT error_type, count(*) AS error_count FROM ({_FAILED}) GROUP BY 1")
sql("error_examples", f"""SELECT error_type, rank, left(error_message, 200) AS example FROM (SELECT *,
  row_number() OVER (PARTITION BY error_type ORDER BY event_time, event_id) AS rank FROM ({_FAILED})) WHERE rank <= 3""")
sql("errors_ranked", f"""SELECT error_type, error_count, example FROM (SELECT error_type, left(error_message, 100) AS example,
  count(*) OVER (PARTITION BY error_type) AS error_count, row_number() OVER (PARTITION BY error_type ORDER BY event_time, event_id) AS rank
  FROM ({_FAILED})) WHERE rank = 1""")
_ORDER = ", ".join(f"({i}, {_text(label)})" for i, (_, label) in enumerate(rules.TIME_BUCKETS, 1))
sql("execution_time_histogram", f"""SELECT o.rank, o.bucket, coalesce(n, 0) AS query_count,
  round(coalesce(n, 0) * 100.0 / (SELECT count(*) FROM qlog WHERE execution_time_ms > 0), 6) AS pct
FROM (VALUES {_ORDER}) o(rank, bucket) LEFT JOIN (SELECT {TIME_BUCKET} AS bucket, count(*) AS n FROM qlog WHERE execution_time_ms > 0 GROUP BY 1) c USING (bucket)""")
sql("execution_time_stats", """SELECT len(l) AS query_count, l[1] AS min_ms, round(list_avg(l), 6) AS avg_ms, l[len(l)] AS max_ms,
  l[len(l) // 2 + 1] AS p50_ms, l[CAST(floor(len(l) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95_ms
FROM (SELECT list(execution_time_ms ORDER BY execution_time_ms) AS l FROM qlog WHERE execution_time_ms > 0)""")
sql("data_scanned_by_user", "SELECT user_id, CAST(sum(data_scanned) AS BIGINT) AS data_scanned FROM qlog WHERE data_scanned > 0 GROUP BY 1")
sql("data_scanned_by_workgroup", "SELECT workgroup, CAST(sum(data_scanned) AS BIGINT) AS data_scanned FROM qlog WHERE data_scanned > 0 GROUP BY 1")
sql("data_scanned_stats", """SELECT count(*) AS query_count, round(avg(data_scanned), 6) AS avg_bytes, max(data_scanned) AS max_bytes,
  CAST(sum(data_scanned) AS BIGINT) AS total_bytes FROM qlog WHERE data_scanned > 0""")
sql("long_running_totals", "SELECT over_10m AS from_10_to_30m, over_30m, over_1h FROM counters")
_FLAGS = "SELECT flag, count(*) AS query_count FROM (SELECT unnest(flags) AS flag FROM tagged) GROUP BY 1"
sql("migration_flag_counts", _FLAGS)
_FLAG_ROWS = """SELECT *, row_number() OVER (PARTITION BY flag ORDER BY event_time, event_id) AS rank
FROM (SELECT *, unnest(flags) AS flag FROM tagged)"""
sql("migration_flag_examples", f"SELECT flag, rank, query_id, user_id, left(query_string, 300) AS query_preview FROM ({_FLAG_ROWS}) WHERE rank <= 5")
sql("flags_ranked", f"""SELECT flag, query_count, left(query_string, 300) AS query_preview FROM ({_FLAGS}) JOIN
  (SELECT * FROM ({_FLAG_ROWS}) WHERE rank = 1) USING (flag)""")
_SPAN = """SELECT min(t) AS a, max(t) AS b, date_diff('second', date_trunc('second', min(t)), max(t)) AS s0,
  epoch_us(max(t)) - epoch_us(min(t)) AS us FROM (SELECT event_time AS t FROM qlog UNION ALL SELECT event_time FROM s3_log)"""
sql("analysis_period", f"""SELECT {time_text("a")} AS earliest_event, {time_text("b")} AS latest_event, us // 86400000000 AS days,
  (us % 86400000000) // 3600000000 AS hours FROM ({_SPAN})""")
sql("avg_queries_per_day", f"""SELECT us // 86400000000 AS days, round(CASE WHEN us // 86400000000 > 0 THEN
  (SELECT count(*) FROM qlog) / (us // 86400000000) ELSE 0 END, 6) AS avg_queries_per_day FROM ({_SPAN})""")
sql("overview", "SELECT * FROM overview")
sql("per_account_overview", "SELECT * FROM acct")


def _rollup(level: str, key: str, member: str, table: str = "facts", last: bool = False, data: str = "CAST(sum(data_scanned) AS BIGINT)", count: str = "CAST(count(*) AS BIGINT)") -> str:
    out = []
    for account in ("account_id", "'ALL'"):
        group = f"{account}, {key}" if account == "account_id" else key
        activity = "NULL"
        if last:
            match = f"e.{key} = f.{key}" + (" AND e.account_id = f.account_id" if account == "account_id" else "")
            activity = f"(SELECT max(event_time) FROM aev e WHERE {match})"
        out.append(
            f"SELECT {account} AS account_id, '{level}' AS level, {key} AS name, {count} AS query_count, "
            f"{data} AS data_scanned, count(DISTINCT {member}) AS unique_members, "
            f"{time_text(f'CAST({activity} AS TIMESTAMP)')} AS last_activity FROM {table} f WHERE {key} IS NOT NULL GROUP BY {group}"
        )
    return " UNION ALL ".join(out)


_TABLE_FACTS = f"(SELECT *, unnest(CASE WHEN len(l) > 0 THEN l ELSE [NULL] END) AS table_name FROM (SELECT *, {tables('query')} AS l FROM facts))"
sql("account_rollup", " UNION ALL ".join((
    _rollup("workgroup", "workgroup", "user_id"),
    _rollup("database", "database", "user_id"),
    _rollup("user", "user_id", "workgroup", last=True),
    _rollup("user_database", "user_id", "database"),
    _rollup("pattern", "pattern_hash", "user_id"),
    _rollup("query_type", "query_type", "user_id"),
    _rollup("database_table", "database", "table_name", _TABLE_FACTS,
            data="CAST(sum(data_scanned) FILTER (i = 1) AS BIGINT)", count="CAST(count(*) FILTER (i = 1) AS BIGINT)").replace(
        "unnest(CASE WHEN len(l) > 0 THEN l ELSE [NULL] END) AS table_name",
        "unnest(CASE WHEN len(l) > 0 THEN l ELSE [NULL] END) AS table_name, generate_subscripts(CASE WHEN len(l) > 0 THEN l ELSE [NULL] END, 1) AS i"),
    _rollup("hour", "hour", "user_id", "(SELECT *, strftime(event_time, '%Y-%m-%dT%H') AS hour FROM aev)", data="CAST(NULL AS BIGINT)"),
    _rollup("bucket", "bucket", "user_id", "sev", data="CAST(NULL AS BIGINT)"),
)))
_MERGED = f"SELECT *, {USER.format(principal=_text(''))} AS user_id, {query_type('query_string')} AS kind, {fingerprint('query_string')} AS hash FROM usage_row"
_MEMBERS = {"unique_users": "user_id", "unique_workgroups": "workgroup", "unique_databases": "db"}
_SUMS = {"query_count": "count(*)", "count": "count(*)", "total_data_scanned": "CAST(sum(data_scanned_bytes) AS BIGINT)",
         "total_execution_time_ms": "CAST(sum(execution_time_ms) AS BIGINT)"}
_MERGED_TABLES = f"SELECT *, unnest({tables('query_string')}) AS table_name FROM ({_MERGED})"
_MERGED_OBJECTS = "SELECT *, CASE WHEN object_key <> '' THEN split_part(object_key, '/', 1) || '/' || split_part(object_key, '/', 2) END AS prefix FROM store_ops"
_BUCKET_SUMS = {**{f"{o}_count": f"count(*) FILTER (operation = '{o}')" for o in ("get", "put", "list")},
                "bytes_in": "CAST(sum(bytes_in) AS BIGINT)", "bytes_out": "CAST(sum(bytes_out) AS BIGINT)",
                "unique_users": "count(DISTINCT user_id)", "unique_prefixes": "count(DISTINCT prefix)"}


def _measures(section: str, key: str, names: str) -> list[str]:
    return [
        f"SELECT '{section}' AS section, {key} AS name, '{m}' AS measure, {_SUMS.get(m) or f'count(DISTINCT {_MEMBERS[m]})'} AS value FROM ({_MERGED}) GROUP BY {key}"
        for m in names.split()
    ]


def _merged_tables(section: str, key: str) -> str:
    return f"""SELECT '{section}', {key}, 'unique_tables', count(DISTINCT table_name) FROM (
  SELECT {key}, table_name FROM ({_MERGED_TABLES}) UNION ALL SELECT {key}, NULL FROM ({_MERGED})) GROUP BY {key}"""


sql("merge_export_summaries", " UNION ALL ".join(
    _measures("workgroup", "workgroup", "query_count total_data_scanned unique_users")
    + _measures("user", "user_id", "query_count unique_workgroups unique_databases")
    + _measures("database", "db", "query_count unique_users") + [_merged_tables("database", "db")]
    + _measures("pattern", "hash", "count total_data_scanned total_execution_time_ms unique_users unique_workgroups unique_databases")
    + [_merged_tables("pattern", "hash")]
    + [f"SELECT 'bucket', bucket, '{m}', {e} FROM ({_MERGED_OBJECTS}) GROUP BY bucket" for m, e in _BUCKET_SUMS.items()]
    + [
        f"SELECT 'query_type', workgroup || '/' || kind, 'query_count', count(*) FROM ({_MERGED}) GROUP BY workgroup, kind",
        "SELECT 'hour', strftime(event_time, '%Y-%m-%dT%H'), 'query_count', count(*) FROM usage_row GROUP BY 2",
    ]
))
ORACLE["merge_stored_summaries"] = ORACLE["merge_export_summaries"]
# Examples of each pattern and file, in order.
_EXAMPLES = f"""SELECT file, hash, ms, unnest(l) AS example, generate_subscripts(l, 1) AS place FROM (
  SELECT account_id || '-' || strftime(event_time, '%Y-%m-%dT%H') || '-' || (id // 1000) AS file, hash,
    CAST(sum(execution_time_ms) // count(*) AS BIGINT) AS ms, list_sort(list_distinct(list({sanitized('query_string')})))[1:5] AS l
  FROM ({_MERGED}) GROUP BY 1, 2)"""
sql("merge_pattern_examples", f"""SELECT name, rank, example FROM (
  SELECT hash AS name, example, row_number() OVER (PARTITION BY hash ORDER BY file, place, example) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY hash, example ORDER BY file, place) AS rn FROM ({_EXAMPLES})) WHERE rn = 1) WHERE rank <= 3""")


def _of_examples(part: str) -> str:
    return PARTS[part].replace("FROM qlog", "FROM exq").replace("FROM complexity", "FROM x_complexity")


_X_PARTS = ("tagged", "complexity", "complex", "ddl", "parted")
sql("summary_example_tags", f"""SELECT kind, tag, count(*) AS query_count FROM (
  WITH exq AS (SELECT example AS query_string, ms, CAST(NULL AS TIMESTAMP) AS event_time FROM ({_EXAMPLES})),
  {", ".join(f"x_{p} AS ({_of_examples(p)})" for p in _X_PARTS)}
  SELECT 'feature' AS kind, unnest(features) AS tag FROM x_tagged UNION ALL SELECT 'flag', unnest(flags) FROM x_tagged
  UNION ALL SELECT 'ddl', ddl_type FROM x_ddl UNION ALL SELECT 'partition', unnest(filters) FROM x_parted
  UNION ALL SELECT 'partition_use', 'full_scan' FROM x_parted WHERE likely_full_scan
  UNION ALL SELECT 'complexity', 'high' FROM x_complex WHERE join_count >= 3 OR subquery_count >= 3
  UNION ALL SELECT 'long_running', CASE WHEN ms >= 3600000 THEN 'over_1h' WHEN ms >= 1800000 THEN 'over_30m' ELSE 'over_10m' END
    FROM exq WHERE ms >= 600000) GROUP BY ALL""")
sql("run_outcome", """SELECT count(*) AS accounts_analysed, count(*) FILTER (error IS NULL) AS accounts_succeeded,
  count(*) FILTER (error IS NOT NULL) AS accounts_failed FROM coverage""")
_REASONS = """concat_ws(' | ',
  CASE WHEN pct > 10 THEN printf('HIGH: %.1f%% queries have 3+ JOINs or deep nesting', pct)
    WHEN pct > 5 THEN printf('MEDIUM: %.1f%% queries have 3+ JOINs or deep nesting', pct)
    WHEN pct > 1 THEN printf('LOW: %.1f%% queries have 3+ JOINs or deep nesting', pct) END,
  CASE WHEN drops > 20 THEN printf('HIGH: %d DROP operations detected - review DDL patterns', drops)
    WHEN drops > 10 THEN printf('MEDIUM: %d DROP operations detected', drops)
    WHEN drops > 5 THEN printf('LOW: %d DROP operations detected', drops) END,
  CASE WHEN over_1h > 5 THEN printf('HIGH: %d queries run over 1 hour', over_1h)
    WHEN over_30m > 10 THEN printf('MEDIUM: %d queries run over 30 minutes', over_30m)
    WHEN over_10m > 20 THEN printf('LOW: %d queries run over 10 minutes', over_10m) END,
  CASE WHEN scan > 30 THEN printf('HIGH: %.1f%% of SELECT queries appear to be full table scans', scan)
    WHEN scan > 15 THEN printf('MEDIUM: %.1f%% of SELECT queries appear to be full table scans', scan) END,
  CASE WHEN risky > 20 THEN printf('HIGH: %d queries use features requiring migration attention', CAST(risky AS BIGINT))
    WHEN risky > 5 THEN printf('MEDIUM: %d queries use features requiring migration attention', CAST(risky AS BIGINT)) END)"""
sql("readiness_score", f"""SELECT 100 - points AS score, points AS complexity,
  CASE WHEN points >= 60 THEN 'LOW' WHEN points >= 40 THEN 'MODERATE' WHEN points >= 20 THEN 'GOOD' ELSE 'HIGH' END AS level,
  {_REASONS} AS considerations, high_complexity AS high_complexity_queries, ddl_operations, drops AS drop_operations,
  over_10m + over_30m AS long_running_queries, full_scans AS full_table_scans, CAST(all_flags AS BIGINT) AS compatibility_flags
FROM (SELECT *, CASE WHEN pct > 10 THEN 30 WHEN pct > 5 THEN 20 WHEN pct > 1 THEN 10 ELSE 0 END
  + CASE WHEN drops > 20 THEN 20 WHEN drops > 10 THEN 15 WHEN drops > 5 THEN 10 ELSE 0 END
  + CASE WHEN over_1h > 5 THEN 20 WHEN over_30m > 10 THEN 15 WHEN over_10m > 20 THEN 10 ELSE 0 END
  + CASE WHEN scan > 30 THEN 15 WHEN scan > 15 THEN 10 ELSE 0 END
  + CASE WHEN risky > 20 THEN 15 WHEN risky > 5 THEN 10 ELSE 0 END AS points
FROM (SELECT *, high_complexity / greatest(events, 1) * 100 AS pct, full_scans / selects * 100 AS scan FROM counters))""")
sql("recommendations", f"""SELECT row_number() OVER (ORDER BY i) AS rank, recommendation FROM (
  SELECT 1 AS i, printf({_text(rules.ADVICE["complex"])}, high_complexity) AS recommendation FROM counters WHERE high_complexity > 0
  UNION ALL SELECT 2, printf({_text(rules.ADVICE["drops"])}, drops) FROM counters WHERE drops > 5
  UNION ALL SELECT 3, printf({_text(rules.ADVICE["long"])}, over_1h) FROM counters WHERE over_1h > 0
  UNION ALL SELECT 4, printf({_text(rules.ADVICE["scans"])}, full_scans) FROM counters WHERE full_scans > 10
  UNION ALL SELECT 5, {_text(rules.ADVICE["small"])} FROM counters WHERE mean_size < 52428800
  UNION ALL SELECT 6, printf({_text(rules.ADVICE["cte"])}, with_cte) FROM counters WHERE with_cte > 50
  UNION ALL SELECT 7, printf({_text(rules.ADVICE["geo"])}, geo) FROM counters WHERE geo > 0
  UNION ALL SELECT 8, printf({_text(rules.ADVICE["federated"])}, federated) FROM counters WHERE federated > 0)""")

# --- ranked tables ---

sql("top_workgroups_by_queries", "SELECT * FROM wg ORDER BY query_count DESC, workgroup LIMIT 10")
sql("top_workgroups_by_data", "SELECT workgroup, total_data_scanned, round(total_data_scanned / 1073741824.0, 6) AS data_scanned_gb FROM wg ORDER BY 2 DESC, 1 LIMIT 10")
sql("top_types_per_workgroup", """SELECT workgroup, query_type, query_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY workgroup ORDER BY query_count DESC, query_type) AS rank
FROM (SELECT workgroup, query_type, count(*) AS query_count FROM facts GROUP BY ALL)) WHERE rank <= 3""")
sql("top_users", f"""SELECT user_id, event_count, {time_text("last_activity")} AS last_activity, coalesce((SELECT array_to_string(l[:3], ', ') || CASE WHEN len(l) > 3 THEN '...' ELSE '' END
  FROM (SELECT list_sort(list(DISTINCT workgroup)) AS l FROM facts f WHERE f.user_id = t.user_id)), '') AS workgroups
FROM (SELECT user_id, count(*) AS event_count, max(event_time) AS last_activity FROM aev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15) t""")
sql("top_databases", "SELECT * FROM dbs ORDER BY query_count DESC, database LIMIT 10")
sql("ranked_patterns", "SELECT row_number() OVER (ORDER BY query_count DESC, pattern_hash) AS rank, pattern_hash, query_count, unique_users FROM patterns")
sql("top_patterns", "SELECT * FROM patterns ORDER BY query_count DESC, pattern_hash LIMIT 15")
sql("top_buckets", "SELECT *, get_count + put_count + list_count AS total_count FROM buckets ORDER BY total_count DESC, bucket LIMIT 10")
sql("last_n_days", f"{_DAYS} ORDER BY day DESC LIMIT 14")
sql("top_features", f"{_TAGS} ORDER BY query_count DESC, feature LIMIT 12")
sql("query_types_top8_other", """SELECT CASE WHEN rank <= 8 THEN query_type ELSE 'Other' END AS query_type, CAST(sum(query_count) AS BIGINT) AS query_count
FROM (SELECT *, row_number() OVER (ORDER BY query_count DESC, query_type) AS rank FROM types) GROUP BY 1""")
sql("longest_queries", """SELECT query_id, user_id, execution_time_ms, CASE WHEN execution_time_ms >= 3600000 THEN 'over_1h' ELSE 'over_30m' END AS long_class,
  round_even(execution_time_ms / 60000, 1) AS execution_time_min, left(query_string, 500) AS query_preview
FROM qlog WHERE execution_time_ms >= 1800000 ORDER BY execution_time_ms DESC, event_time, event_id LIMIT 10""")
sql("top_scanners", f"""SELECT user_id, data_scanned, {bytes_text("data_scanned")} AS data_scanned_text FROM (SELECT user_id, CAST(sum(data_scanned) AS BIGINT) AS data_scanned
FROM qlog WHERE data_scanned > 0 GROUP BY 1) ORDER BY 2 DESC, 1 LIMIT 10""")

# --- set operations ---

sql("union_accounts", "SELECT event_id, event_name, account_id FROM aev")
sql("union_exports", f"SELECT event_id, {time_text('event_time')} AS event_time FROM usage_row")
sql("distinct_members", """SELECT DISTINCT workgroup, 'user' AS kind, user_id AS member FROM facts
UNION ALL SELECT DISTINCT workgroup, 'database', database FROM facts""")
_BUNDLES = """SELECT 'usage-' || strftime(event_time, '%Y%m%d%H') || '-' || account_id || '-' || (id // 1000) || '.zip' AS file, account_id,
  strftime(event_time, '%H') >= '12' AS inside, count(*) AS n FROM usage_row GROUP BY ALL"""
sql("per_account_first_source", f"""SELECT file, 'summary' AS source, account_id, n AS total_athena_events FROM ({_BUNDLES}) WHERE inside
UNION ALL SELECT file, 'member', account_id, n FROM ({_BUNDLES}) WHERE file = (SELECT min(file) FROM ({_BUNDLES}))
  AND file < (SELECT min(file) FROM ({_BUNDLES}) WHERE inside)""")

# --- streaming ---

sql("stream_events", f"SELECT event_id, {time_text('event_time')} AS event_time, workgroup, status FROM usage_log")
sql("stream_dedupe", f"SELECT event_id, {time_text('event_time')} AS event_time FROM usage_row")
sql("stream_hourly_counts", "SELECT strftime(event_time, '%Y-%m-%dT%H') AS hour, count(*) AS event_count FROM usage_row GROUP BY 1")
sql("stream_minute_peak", "SELECT max(n) AS peak_concurrency FROM (SELECT count(*) AS n FROM usage_row GROUP BY date_trunc('minute', event_time))")
sql("stream_workgroup_stats", """SELECT workgroup, count(*) AS query_count, CAST(sum(data_scanned) AS BIGINT) AS data_scanned,
  count(DISTINCT user_id) AS unique_users FROM qlog GROUP BY 1""")
sql("stream_enrich", """SELECT event_id, u.query_execution_id, CASE WHEN s.found THEN s.query ELSE u.query_string END AS query,
  CASE WHEN s.found THEN s.workgroup ELSE u.workgroup END AS workgroup, CASE WHEN s.found THEN s.database ELSE u.db END AS database,
  coalesce(s.status, '') AS status, coalesce(s.data_scanned, 0) AS data_scanned
FROM usage_row u LEFT JOIN (SELECT *, true AS found FROM stats) s ON u.query_execution_id = s.query_execution_id""")
