"""Rule tables and lists. Everything here is data; users may pass their own rows.

A rule is (tag, pattern, needles, on raw text?). The needles are plain
substrings one of which every match contains: a cheap ``contains`` runs first
and the pattern only on the rows that pass it.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    tag: str
    pattern: str
    needles: tuple[str, ...] = ()
    raw: bool = False


# --- Fixed values: names, lists, patterns and thresholds the results depend on ---

QUERY_SOURCE = "athena.amazonaws.com"
STORE_SOURCE = "s3.amazonaws.com"

QUERY_EVENT_NAMES = (
    "StartQueryExecution", "StopQueryExecution", "GetQueryExecution", "GetQueryResults",
    "CreateNamedQuery", "DeleteNamedQuery", "GetNamedQuery", "ListNamedQueries",
    "BatchGetNamedQuery",
    "CreateWorkGroup", "DeleteWorkGroup", "GetWorkGroup", "ListWorkGroups", "UpdateWorkGroup",
    "CreateDataCatalog", "DeleteDataCatalog", "GetDataCatalog", "ListDataCatalogs",
    "GetDatabase", "ListDatabases", "GetTableMetadata", "ListTableMetadata",
    "CreatePreparedStatement", "DeletePreparedStatement", "GetPreparedStatement",
    "ListPreparedStatements",
    "StartSession", "TerminateSession", "GetSession", "ListSessions",
    "StartCalculationExecution", "StopCalculationExecution", "GetCalculationExecution",
    "ListCalculationExecutions",
)

STORE_EVENT_NAMES = ("GetObject", "PutObject", "ListObjects", "ListObjectsV2", "HeadObject")

BUCKET_WORDS = (
    "athena", "query-results", "datalake", "data-lake", "analytics", "warehouse",
    "raw", "processed", "curated",
)

DEFAULT_WORKGROUP = "primary"
DEFAULT_DATABASE = "default"
UNKNOWN_USER = "unknown"

LOOKBACK_DAYS = 90
LOOKBACK_MINUTES = 60

# Statement type by the start of the trimmed upper-case text, first match.
STATEMENT_PREFIXES = (
    ("CREATE TABLE", "CREATE_TABLE"),
    ("CREATE VIEW", "CREATE_VIEW"),
    ("DROP", "DROP"),
    ("ALTER", "ALTER"),
    ("INSERT", "INSERT"),
    ("SHOW", "SHOW"),
    ("DESCRIBE", "DESCRIBE"),
    ("MSCK", "MSCK_REPAIR"),
    ("UNLOAD", "UNLOAD"),
)

TABLE_NAME = r"([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)?)"
NOT_TABLES = ("select", "from", "where", "and", "or", "as", "on")

_DIALECT_FUNCTIONS = (
    "TRY", "TRY_CAST", "APPROX_DISTINCT", "APPROX_PERCENTILE", "MAP_AGG", "ARRAY_AGG",
    "MULTIMAP_AGG", "HISTOGRAM", "SEQUENCE", "REPEAT", "FROM_UNIXTIME", "TO_UNIXTIME",
    "DATE_TRUNC", "DATE_ADD", "DATE_DIFF", "JSON_EXTRACT", "JSON_EXTRACT_SCALAR",
)
_WINDOW_FUNCTIONS = (
    "ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE", "LEAD", "LAG", "FIRST_VALUE",
    "LAST_VALUE", "NTH_VALUE", "OVER",
)
_LAMBDA_FUNCTIONS = (
    "TRANSFORM", "FILTER", "REDUCE", "ZIP_WITH", "MAP_FILTER", "MAP_TRANSFORM_KEYS",
    "MAP_TRANSFORM_VALUES",
)


def _call(names: tuple[str, ...]) -> str:
    return rf"\b(?:{'|'.join(names)})\s*\("


FEATURE_RULES: tuple[Rule, ...] = (
    Rule("CTE", r"\bWITH\s+\w+\s+AS\s*\(", ("WITH",)),
    Rule("Window Functions", _call(_WINDOW_FUNCTIONS), _WINDOW_FUNCTIONS),
    Rule("UNNEST", _call(("UNNEST",)), ("UNNEST",)),
    Rule("Lambda Expressions", r"->", ("->",), raw=True),
    Rule("Array/Map Functions", _call(_LAMBDA_FUNCTIONS), _LAMBDA_FUNCTIONS),
    *(Rule(f"Trino: {name}()", _call((name,)), (name,)) for name in _DIALECT_FUNCTIONS),
    *(
        Rule(f"Trino: {kind} Type Cast", rf"\bCAST\s*\([^)]+\s+AS\s+{kind}\s*\(", ("CAST",))
        for kind in ("ROW", "ARRAY", "MAP")
    ),
    Rule("Array Literals", r"\bARRAY\s*\[", ("ARRAY",)),
    Rule("Map Literals", r"\bMAP\s*\(", ("MAP",)),
    Rule("Map Literals", r"\bMAP\s*\{", ("MAP",), raw=True),
    Rule("Row/Struct Types", r"\bROW\s*\(", ("ROW",)),
    Rule("GROUPING SETS", r"\bGROUPING\s+SETS\s*\(", ("GROUPING",)),
    Rule("CUBE", r"\bCUBE\s*\(", ("CUBE",)),
    Rule("ROLLUP", r"\bROLLUP\s*\(", ("ROLLUP",)),
    Rule("TABLESAMPLE", r"\bTABLESAMPLE\s+", ("TABLESAMPLE",)),
    Rule("Derived Tables", r"\bFROM\s*\(\s*SELECT\b", ("FROM",)),
    Rule("CROSS JOIN UNNEST", r"\bCROSS\s+JOIN\s+UNNEST\s*\(", ("UNNEST",)),
    Rule("LATERAL", r"\bLATERAL\s*\(", ("LATERAL",)),
)

FEATURE_NOTES = {
    "CTE": "Common Table Expressions - widely supported",
    "Window Functions": "Check specific function compatibility",
    "UNNEST": "Array expansion - verify syntax compatibility",
    "Lambda Expressions": "May require syntax adjustment",
    "Array/Map Functions": "Verify function availability",
    "CROSS JOIN UNNEST": "Common pattern - verify support",
    "GROUPING SETS": "Advanced aggregation - check support",
    "CUBE": "Advanced aggregation - check support",
    "ROLLUP": "Advanced aggregation - check support",
    "TABLESAMPLE": "Table sampling - may not be supported",
    "LATERAL": "Lateral joins - verify support",
}
DIALECT_NOTE = "Trino/Presto specific - verify equivalent"
DEFAULT_NOTE = "Review for compatibility"

FLAG_RULES: tuple[Rule, ...] = (
    Rule("CTAS", r"\bCREATE\s+(EXTERNAL\s+)?TABLE\s+.*\s+AS\s+SELECT\b", ("CREATE",)),
    Rule("INSERT_WITH_PARTITION", r"\bINSERT\s+(INTO|OVERWRITE)\s+.*\bPARTITION\s*\(", ("INSERT",)),
    Rule("ACID_TABLE", r"\bUSING\s+(ICEBERG|HUDI|DELTA)\b", ("USING",)),
    Rule("MERGE_INTO", r"\bMERGE\s+INTO\b", ("MERGE",)),
    Rule("DELETE_FROM", r"\bDELETE\s+FROM\b", ("DELETE",)),
    Rule("UPDATE", r"\bUPDATE\s+\w+\s+SET\b", ("UPDATE",)),
    Rule(
        "GEOSPATIAL",
        r"\bST_\w+\s*\(|\bGEOMETRY\b|\b(?:POINT|POLYGON|LINESTRING)\s*\(",
        ("ST_", "GEOMETRY", "POINT", "POLYGON", "LINESTRING"),
    ),
    Rule("JSON_EXTRACT", r"\bJSON_EXTRACT\s*\(", ("JSON_EXTRACT",)),
    Rule("JSONPATH", r"\$\.", ("$.",), raw=True),
    Rule("FEDERATED_QUERY", r"\bFROM\s+\w+\.\w+\.\w+\.\w+", ("FROM",)),
    Rule("UNLOAD", r"\bUNLOAD\s*\(", ("UNLOAD",)),
    Rule("EXPLAIN", r"^\s*EXPLAIN\b", ("EXPLAIN",)),
    Rule(
        "PREPARED_STATEMENTS",
        r"\bPREPARE\b|\bEXECUTE\b|\bDEALLOCATE\b",
        ("PREPARE", "EXECUTE", "DEALLOCATE"),
    ),
)
RISKY_FLAGS = ("GEOSPATIAL", "FEDERATED_QUERY", "UNLOAD")
FLAG_EXAMPLES = 5

# Join kinds in counting order. The bare kind is a JOIN with none of the six
# words, each followed by a blank, inside the ten characters before it.
JOIN_RULES = (
    ("LEFT OUTER", r"\bLEFT\s+OUTER\s+JOIN\b"),
    ("RIGHT OUTER", r"\bRIGHT\s+OUTER\s+JOIN\b"),
    ("FULL OUTER", r"\bFULL\s+OUTER\s+JOIN\b"),
    ("LEFT", r"\bLEFT\s+JOIN\b"),
    ("RIGHT", r"\bRIGHT\s+JOIN\b"),
    ("INNER", r"\bINNER\s+JOIN\b"),
    ("CROSS", r"\bCROSS\s+JOIN\b"),
    (
        "JOIN",
        r"(?<!(?:LEFT |FULL )[\s\S]{0,5})(?<!(?:RIGHT |INNER |CROSS |OUTER )[\s\S]{0,4})\bJOIN\b",
    ),
)
CTE_PATTERN = r"\bWITH\s+(\w+)\s+AS\s*\("
SUBQUERY_PATTERN = r"\(\s*SELECT\b"
UNION_PATTERN = r"\bUNION\s+(ALL\s+)?"
GROUP_BY_PATTERN = r"\bGROUP\s+BY\b"
AGGREGATE_NAMES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "ARRAY_AGG", "STRING_AGG")
AGGREGATION_PATTERN = _call(AGGREGATE_NAMES)
UNGROUPED_PATTERN = r"SELECT\s+(?!.*\bCOUNT\s*\(\s*\*\s*\)\s*$)"
HIGH_COMPLEXITY = 3
MULTIPLE_JOINS = 2

DDL_RULES = (
    ("CREATE", r"^CREATE\s+(OR\s+REPLACE\s+)?(EXTERNAL\s+)?(TABLE|VIEW|SCHEMA|DATABASE)"),
    ("DROP", r"^DROP\s+(TABLE|VIEW|SCHEMA|DATABASE)"),
    ("ALTER", r"^ALTER\s+(TABLE|VIEW|SCHEMA|DATABASE)"),
    ("TRUNCATE", r"^TRUNCATE\s+TABLE"),
    ("REPAIR", r"^MSCK\s+REPAIR\s+TABLE"),
)
DDL_STARTS = ("CREATE", "DROP", "ALTER", "TRUNCATE", "MSCK")
DDL_OBJECT_PATTERN = (
    r"(TABLE|VIEW)\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?"
    r"([`\"']?\w+[`\"']?\.)?([`\"']?\w+[`\"']?)"
)
DDL_SAMPLE_TYPES = ("DROP", "CREATE", "ALTER", "TRUNCATE")

PARTITION_COLUMNS = (
    "partition", "dt", "date", "year", "month", "day", "region", "country", "event_date",
    "created_date", "load_date", "process_date", "etl_date", "p_date",
)
WHERE_PATTERN = r"\bWHERE\b"
SELECT_START_PATTERN = r"^\s*SELECT\b"
SMALL_LIMIT_PATTERN = r"\bLIMIT\s+[1-9]\d{0,1}\b"

# Error classes by words in the lower-case message, first match. Each inner
# tuple is a set of words that must all be there.
ERROR_RULES = (
    ("Timeout", (("timeout",), ("timed out",))),
    ("Memory Exceeded", (("memory",), ("oom",))),
    ("Syntax Error", (("syntax",), ("parse",))),
    ("Permission Denied", (("permission",), ("access denied",), ("not authorized",))),
    ("Resource Not Found", (("does not exist",), ("not found",))),
    ("Type Error", (("type", "mismatch"), ("type", "cannot be"))),
    ("Division By Zero", (("division by zero",),)),
    ("Limit Exceeded", (("limit",),)),
    ("Query Cancelled", (("cancelled",), ("canceled",))),
    ("Internal Error", (("internal",),)),
)
OTHER_ERROR = "Other Error"

TIME_BUCKETS = (
    (1_000, "< 1 second"),
    (5_000, "1-5 seconds"),
    (30_000, "5-30 seconds"),
    (60_000, "30s - 1 minute"),
    (300_000, "1-5 minutes"),
    (600_000, "5-10 minutes"),
    (None, "> 10 minutes"),
)

# Long-running classes by least minutes, first match.
LONG_RUNNING = ((60, "over_1h"), (30, "over_30m"), (10, "over_10m"))

BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
SMALL_OBJECT_BYTES = 10 * 1024 * 1024
MEDIUM_OBJECT_BYTES = 50 * 1024 * 1024

# Readiness rungs: (threshold exceeded, points, reason text), first that holds.
COMPLEXITY_RUNGS = (
    (10, 30, "HIGH: %.1f%% queries have 3+ JOINs or deep nesting"),
    (5, 20, "MEDIUM: %.1f%% queries have 3+ JOINs or deep nesting"),
    (1, 10, "LOW: %.1f%% queries have 3+ JOINs or deep nesting"),
)
DROP_RUNGS = (
    (20, 20, "HIGH: %d DROP operations detected - review DDL patterns"),
    (10, 15, "MEDIUM: %d DROP operations detected"),
    (5, 10, "LOW: %d DROP operations detected"),
)
LONG_RUNGS = (
    (5, 20, "HIGH: %d queries run over 1 hour"),
    (10, 15, "MEDIUM: %d queries run over 30 minutes"),
    (20, 10, "LOW: %d queries run over 10 minutes"),
)
SCAN_RUNGS = (
    (30, 15, "HIGH: %.1f%% of SELECT queries appear to be full table scans"),
    (15, 10, "MEDIUM: %.1f%% of SELECT queries appear to be full table scans"),
)
FLAG_RUNGS = (
    (20, 15, "HIGH: %d queries use features requiring migration attention"),
    (5, 10, "MEDIUM: %d queries use features requiring migration attention"),
)
READINESS_LEVELS = ((60, "LOW"), (40, "MODERATE"), (20, "GOOD"))
BEST_LEVEL = "HIGH"

ADVICE = {
    "complex": "Review %d high-complexity queries with 3+ JOINs - these may cause query optimizer issues",
    "drops": "Review DDL patterns: %d DROP operations detected - consider implementing DDL governance",
    "long": "Investigate %d queries running over 1 hour - verify query cancellation capability in target platform",
    "scans": "Optimize %d potential full table scans - verify scan limits in target platform",
    "small": "Consider file compaction - small files cause API throttling and performance issues",
    "cte": "Review %d queries using CTEs - these create temp result sets that stress Spark optimizer",
    "geo": "Validate %d geospatial queries - check Spark SQL compatibility",
    "federated": "Plan migration for %d federated queries - may require different approach in target platform",
    "none": "No significant migration considerations detected - proceed with standard migration approach",
}
ADVICE_DROPS_OVER = 5
ADVICE_SCANS_OVER = 10
ADVICE_CTES_OVER = 50

# Characters a text strip removes: all white space, not the blank alone.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# --- End of fixed values ---
