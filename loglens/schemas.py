"""Explicit schemas, so that JSON parsing reads only the fields that are used."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


S, L = T.StringType(), T.LongType()

# Request and response stay whole as JSON text; the fields used are read from it.
RECORD = _struct(
    eventID=S,
    eventName=S,
    eventSource=S,
    eventTime=S,
    userIdentity=_struct(arn=S, principalId=S),
    awsRegion=S,
    sourceIPAddress=S,
    requestParameters=S,
    responseElements=S,
    additionalEventData=S,
    errorCode=S,
    recipientAccountId=S,
)
AUDIT_FILE = _struct(Records=T.ArrayType(RECORD))

REQUEST = _struct(
    workGroup=S,
    queryString=S,
    queryExecutionId=S,
    queryExecutionContext=_struct(database=S),
    bucketName=S,
    key=S,
)
RESPONSE = _struct(
    queryExecutionId=S,
    queryExecution=_struct(
        queryExecutionId=S, workGroup=S, statistics=_struct(dataScannedInBytes=L)
    ),
)
TRANSFER = _struct(bytesTransferredIn=L, bytesTransferredOut=L)

EXECUTION = _struct(
    QueryExecutionId=S,
    Query=S,
    WorkGroup=S,
    QueryExecutionContext=_struct(Database=S),
    Status=_struct(State=S),
    Statistics=_struct(DataScannedInBytes=L, EngineExecutionTimeInMillis=L),
)

ACCOUNT = _struct(Id=S, Name=S, Email=S, Status=S)

_NAMES = T.ArrayType(S)
_WORKGROUP = _struct(
    query_count=L, users=_NAMES, total_data_scanned=L, query_types=T.MapType(S, L)
)
_USER = _struct(query_count=L, workgroups=_NAMES, databases=_NAMES, last_activity=S)
_DATABASE = _struct(query_count=L, tables=_NAMES, users=_NAMES)
_PATTERN = _struct(
    count=L,
    examples=_NAMES,
    users=_NAMES,
    workgroups=_NAMES,
    databases=_NAMES,
    tables=_NAMES,
    total_data_scanned=L,
    total_execution_time_ms=L,
)
_BUCKET = _struct(
    get_count=L, put_count=L, list_count=L, bytes_in=L, bytes_out=L, prefixes=_NAMES, users=_NAMES
)
_OVERVIEW = _struct(
    total_athena_events=L,
    total_s3_events=L,
    query_execution_ids_found=L,
    queries_fetched_from_athena=L,
    unique_users=L,
    unique_workgroups=L,
    unique_databases=L,
    unique_query_patterns=L,
)
ACCOUNT_SUMMARY = _struct(account_id=S, error=S, overview=_OVERVIEW)
SUMMARY = _struct(
    configuration=_struct(analysis_mode=S, multi_account_method=S),
    overview=_OVERVIEW,
    workgroup_stats=T.MapType(S, _WORKGROUP),
    user_stats=T.MapType(S, _USER),
    database_stats=T.MapType(S, _DATABASE),
    query_patterns=T.MapType(S, _PATTERN),
    s3_bucket_stats=T.MapType(S, _BUCKET),
    hourly_query_counts=T.MapType(S, L),
    per_account=T.ArrayType(ACCOUNT_SUMMARY),
)

# Rows of a log export, with the two spellings some fields have.
LOG_EVENT = _struct(
    event_id=S,
    event_name=S,
    event_time=S,
    user_id=S,
    user_arn=S,
    account_id=S,
    workgroup=S,
    work_group=S,
    database=S,
    status=S,
    error_message=S,
    state_change_reason=S,
    execution_time_ms=L,
    query_string=S,
    query=S,
    query_execution_id=S,
    query_id=S,
    data_scanned_bytes=L,
    data_scanned_in_bytes=L,
)
STORE_EVENT = _struct(
    event_id=S,
    event_name=S,
    event_time=S,
    user_id=S,
    account_id=S,
    bucket=S,
    key=S,
    bytes_transferred=L,
    object_size=L,
    additionalEventData=TRANSFER,
)
