"""One registered query per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loglens import functions as fn, rules, schemas, streaming as st
from loglens.operators import accounts as ac
from loglens.operators import events as ev
from loglens.operators import facts as fc
from loglens.operators import members as mb
from loglens.operators import overview as ov
from loglens.operators import querylog as ql
from loglens.operators import ranking as rk
from loglens.operators import readiness as rd
from loglens.operators import store as so
from loglens.operators import usage as us
from loglens.plans.collector import Collected, collect_usage, land_records as land, summary_sections
from loglens.session import for_workers, store_table, use_utc, work_dir
from loglens import sinks, sources

from .fixtures import ALLOWED, LOCAL_ACCOUNT, raw_audit, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PERIOD = ev.Period.of("2024-01-05T00:00:00Z", "2024-01-20T12:00:00Z")


def flat(df: DataFrame) -> DataFrame:
    """Plain columns for comparison: long numbers, rounded doubles, text times,
    joined sorted arrays."""
    columns = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.DecimalType)):
            c = c.cast("bigint")
        elif isinstance(kind, T.DoubleType):
            c = F.round(c, 6)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(F.array_sort(c), ",")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(body: Query) -> Query:
    QUERIES[body.__name__] = lambda spark, sf: flat(body(spark, sf))
    return body


# --- shared inputs ---


_LANDED: dict[tuple[str, str], str] = {}


def _land(spark: SparkSession, sf: str, path: str) -> DataFrame:
    return land(raw_audit(spark, sf), path)


def landed(spark: SparkSession, sf: str) -> DataFrame:
    """The audit records as flat Parquet, written once per session and folder,
    as an ingest job would; the report queries read it. ``land_records`` below
    is that job as a query of its own."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LANDED:
        path = work_dir(spark, "landed")
        _land(spark, sf, path)
        _LANDED[key] = path
    return spark.read.parquet(_LANDED[key])


def collected(spark: SparkSession, sf: str) -> Collected:
    use_utc(spark)
    stats = sources.read_execution_stats(view(spark, sf, "execution_stats"))
    return collect_usage(landed(spark, sf), stats, ALLOWED)


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    """Flat query-service rows, neither deduplicated nor filtered."""
    routed = ev.route_events(raw_audit(spark, sf))
    return ev.normalize_athena_events(routed.filter("route = 'query'"))


def store_audit(spark: SparkSession, sf: str) -> DataFrame:
    routed = ev.route_events(raw_audit(spark, sf))
    return ev.normalize_s3_events(routed.filter("route = 'store'"))


def usage(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "usage_log")


def log(spark: SparkSession, sf: str) -> DataFrame:
    """The deduplicated query log."""
    return ql.query_log(ev.dedupe_events(usage(spark, sf)))


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return ql.classify_log(log(spark, sf))


def texts(spark: SparkSession, sf: str, *keys: str) -> DataFrame:
    """Classified distinct texts with their number of log rows."""
    return ql.classify_log(ql.text_cells(log(spark, sf), *keys))


def store(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "s3_log").withColumnRenamed("object_key", "key")


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "accounts")


def overviews(spark: SparkSession, sf: str) -> DataFrame:
    run = collected(spark, sf)
    return ov.per_account_overview(run.events, run.store_events, run.starts, run.facts)


# --- sources ---


def _write_audit_files(spark: SparkSession, sf: str, name: str, folder: str) -> str:
    """The audit records as gzip files by day or account; a file holds the
    records of at most 5000 consecutive source rows."""
    root = work_dir(spark, name)
    rows = raw_audit(spark, sf, "id")
    nested = ("requestParameters", "responseElements")
    record = F.struct(*(c for c in rows.columns if c not in (*nested, "id")))
    parts = rows.withColumns(
        {
            "account": F.concat(F.lit("AWSLogs-"), "recipientAccountId"),
            # Records without a time lie in a folder of their own.
            "day": F.coalesce(F.nullif(F.regexp_extract("eventTime", r"^\d{4}-\d\d-\d\d", 0), F.lit("")), F.lit("none")),
            "part": F.floor(F.col("id") / 5000),
            "record": F.to_json(record),
        }
    )
    # Request and response are objects in the file, so their JSON is spliced in.
    body = F.concat(
        F.expr("left(record, length(record) - 1)"),
        *(
            F.concat(F.lit(f',"{name}":'), F.coalesce(name, F.lit("null")))
            for name in nested
        ),
        F.lit("}"),
    )
    files = parts.groupBy(folder, "part").agg(F.collect_list(body).alias("records"))
    lines = files.select(
        folder,
        F.concat(F.lit('{"Records":['), F.array_join("records", ","), F.lit("]}")).alias("value"),
    )
    (
        lines.hint("rebalance", F.col(folder))
        .write.partitionBy(folder)
        .option("maxRecordsPerFile", 1)
        .option("compression", "gzip")
        .text(root)
    )
    return root


_DAY_LAYOUT = "{root}/day={day}"


def _audit_columns(records: DataFrame) -> DataFrame:
    kept = ["eventID", "eventName", "eventSource", "eventTime", "errorCode"]
    extra = [c for c in records.columns if c == "account_id"]
    return records.select(
        *kept, F.col("userIdentity.arn").alias("userArn"), "requestParameters", *extra
    )


def _audit_query(
    spark: SparkSession,
    sf: str,
    name: str,
    period: ev.Period | None = None,
    folder: str = "day",
    **options,
) -> DataFrame:
    root = _write_audit_files(spark, sf, name, folder)
    path = root
    if period is not None:
        path = sources.audit_paths(root, period, _DAY_LAYOUT, "%Y-%m-%d")
    return _audit_columns(sources.read_audit_files(spark, path, **options)).drop("requestParameters")


@query
def read_audit_files(spark, sf):
    return _audit_query(spark, sf, "audit")


LARGEST_FILE = 65536
FILE_RECORDS = 200


def _write_org_files(spark: SparkSession, sf: str) -> str:
    """The audit records as an organization's trail lays them down: a folder per account and
    day, gzip files of at most 200 records, and for some accounts a broken, an empty and a
    too large file (whose record must never show up)."""
    root = work_dir(spark, "org-trail")
    rows = raw_audit(spark, sf, "id")
    nested = ("requestParameters", "responseElements")
    day = F.nullif(F.regexp_extract("eventTime", r"^\d{4}-\d\d-\d\d", 0), F.lit(""))
    body = F.to_json(F.struct(*(c for c in rows.columns if c not in (*nested, "id"))))
    whole = F.concat(
        F.expr("left(body, length(body) - 1)"), *(F.concat(F.lit(f',"{n}":'), F.coalesce(n, F.lit("null"))) for n in nested), F.lit("}")
    )
    parts = rows.withColumn("body", body).select(
        F.col("recipientAccountId").alias("account"), F.replace(F.coalesce(day, F.lit("2024-02-29")), F.lit("-"), F.lit("/")).alias("day"), whole.alias("body")
    )

    def put(batches):
        import gzip
        import random

        import pandas as pd
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")

        def write(folder, name, data):
            with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(data)

        def put_file(folder, start, bodies):
            text = '{"Records":[' + ",".join(bodies) + "]}"
            write(folder, f"{start}.json.gz", gzip.compress(text.encode()))

        # At most one file's records of each folder are held, however many a folder gets.
        held, starts = {}, {}
        for batch in batches:
            for account, day, body in zip(batch["account"], batch["day"], batch["body"]):
                key = (account, day)
                folder = f"{place}/AWSLogs/o-1/{account}/CloudTrail/eu-west-1/{day}"
                if key not in held:
                    system.create_dir(folder, recursive=True)
                    held[key], starts[key] = [], 0
                if len(held[key]) == FILE_RECORDS:
                    put_file(folder, starts[key], held[key])
                    starts[key] += FILE_RECORDS
                    held[key] = []
                held[key].append(body)
            yield pd.DataFrame({"written": [len(batch)]})
        for (account, day), bodies in held.items():
            folder, k = f"{place}/AWSLogs/o-1/{account}/CloudTrail/eu-west-1/{day}", starts[account, day]
            put_file(folder, k, bodies)
            if int(account) % 5 == 1:
                decoy = '{"eventID":"decoy","eventName":"' + random.Random(k).randbytes(LARGEST_FILE).hex() + '"}'
                write(folder, "large.json.gz", gzip.compress(b'{"Records":[' + decoy.encode() + b"]}"))
            if int(account) % 5 == 2:
                write(folder, "broken.json.gz", gzip.compress(b'{"Records":[{"eventID":"decoy"}')[:-3])
            if int(account) % 5 == 3:
                write(folder, "empty.json.gz", gzip.compress(b'{"Records":[]}'))

    for_workers(parts).repartition("account", "day").mapInPandas(put, "written long").agg(F.sum("written")).collect()
    return root


def _scan_rows(scan: DataFrame) -> DataFrame:
    """Records, and a row for each file that gave none."""
    scan = store_table(scan, "audit-scan")
    kept = ["eventID", "eventName", "eventSource", "eventTime", "errorCode"]
    records = sources.audit_records(scan).select(*kept, F.col("userIdentity.arn").alias("userArn"), F.lit("").alias("problem"), "account_id")
    name = F.substring_index("path", "/", -4)
    lost = sources.audit_problems(scan).select(
        name.alias("eventID"), *(F.lit(None).cast("string").alias(c) for c in (*kept[1:], "userArn")),
        F.substring_index("problem", ":", 1).alias("problem"), "account_id",
    )
    return records.unionByName(lost)


@query
def audit_file_size_filter(spark, sf):
    """Every file of the trail up to a size; larger and broken ones are rows of their own."""
    root = _write_org_files(spark, sf)
    return _scan_rows(sources.scan_audit_files(spark, root, max_bytes=LARGEST_FILE, account_pattern=sources.ORG_ACCOUNT))


@query
def audit_date_prefixes(spark, sf):
    return _audit_query(spark, sf, "dates", PERIOD)


@query
def audit_org_prefixes(spark, sf):
    """The organization's files of a period, all accounts in one read, problems recorded."""
    root = _write_org_files(spark, sf)
    return _scan_rows(sources.scan_org_audit_files(spark, root, PERIOD, "o-1", max_bytes=LARGEST_FILE))


@query
def unwrap_api_record(spark, sf):
    records = raw_audit(spark, sf)
    odd = F.pmod(F.xxhash64("eventID"), F.lit(2)) == 1
    text = F.when(odd, F.to_json(F.struct(*records.columns)))
    mixed = records.select(
        text.alias("CloudTrailEvent"),
        *(F.when(~odd, F.col(c)).alias(c) for c in records.columns),
    )
    out = ev.unwrap_api_record(mixed)
    return out.select(
        "eventID",
        "eventName",
        "eventSource",
        "eventTime",
        F.col("userIdentity.arn").alias("userArn"),
        F.get_json_object("requestParameters", "$.queryString").alias("queryString"),
    )


def _write_bundles(spark: SparkSession, sf: str, name: str, per_account: bool = False) -> str:
    """One zip per account, hour and thousand source rows, as rows of a table."""
    run = view(spark, sf, "usage_row")
    row = F.to_json(
        F.struct("event_id", "event_time", "user_arn", "workgroup", "status", "query_string")
    )
    keyed = run.select(
        "account_id",
        F.date_format("event_time", "yyyyMMddHH").alias("hour"),
        F.floor(F.col("id") / 1000).alias("part"),
        row.alias("body"),
    )
    root = work_dir(spark, name)

    def pack(batches):
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            out = []
            for account, hour, part, bodies in batch[["account_id", "hour", "part", "bodies"]].values:
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as bundle:
                    summary = f'{{"overview":{{"total_athena_events":{len(bodies)}}}'
                    one = f'{{"account_id":"{account}","overview":{{"total_athena_events":{len(bodies)}}}}}'
                    # Hours from noon on carry the account row in the summary.
                    if per_account and hour[8:] >= "12":
                        summary += f',"per_account":[{one}]'
                    bundle.writestr("summary.json", summary + "}")
                    bundle.writestr("athena_events.json", "[" + ",".join(bodies) + "]")
                    if per_account:
                        bundle.writestr("per_account_summary.json", f"[{one}]")
                out.append((f"usage-{hour}-{account}-{part}.zip", buffer.getvalue()))
            yield pd.DataFrame(out, columns=["file", "content"])

    grouped = keyed.groupBy("account_id", "hour", "part").agg(F.collect_list("body").alias("bodies"))
    files = for_workers(grouped).mapInPandas(pack, "file string, content binary")
    files.write.parquet(root)
    return root


def _bundle_members(spark: SparkSession, sf: str, name: str, per_account: bool = False) -> DataFrame:
    """Members of the bundles; the zips are the rows of one binary column here."""
    from loglens.sources.bundles import unzip_members

    root = _write_bundles(spark, sf, name, per_account)
    return unzip_members(spark.read.parquet(root).withColumnRenamed("file", "path"))


@query
def land_records(spark, sf):
    rows = _land(spark, sf, work_dir(spark, "land"))
    return rows.select("route", "event_id", "event_name", "account_id", "event_date", "user_id", "bucket", "query_string")


def _write_bundle_files(spark: SparkSession, sf: str) -> str:
    """One zip file per account and day, as the exports lie in a store: four members each, and
    for some accounts a copy that is cut off and one whose event list is no JSON."""
    root = work_dir(spark, "bundle-files")
    log = view(spark, sf, "usage_row").select(
        "account_id", F.date_format("event_time", "yyyyMMdd").alias("day"), F.lit("athena").alias("kind"),
        F.to_json(F.struct("event_id", "event_time", "user_arn", "workgroup", "status", "query_string")).alias("body"),
    )
    moved = F.struct(F.col("extra_bytes_in").alias("bytesTransferredIn"), F.col("extra_bytes_out").alias("bytesTransferredOut"))
    stored = view(spark, sf, "s3_log").select(
        "account_id", F.date_format("event_time", "yyyyMMdd").alias("day"), F.lit("s3").alias("kind"),
        F.to_json(F.struct("event_id", "event_name", "event_time", "bucket", F.col("object_key").alias("key"), "bytes_transferred", moved.alias("additionalEventData"))).alias("body"),
    )
    grouped = log.unionByName(stored).groupBy("account_id", "day").pivot("kind", ["athena", "s3"]).agg(F.collect_list("body"))

    def pack(batches):
        import zipfile

        import pandas as pd
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        system.create_dir(place, recursive=True)

        def write(name, members):
            with system.open_output_stream(f"{place}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as bundle:
                for member, text in members.items():
                    bundle.writestr(member, text)

        for batch in batches:
            for account, day, athena, store_rows in zip(batch["account_id"], batch["day"], batch["athena"], batch["s3"]):
                one = f'{{"account_id":"{account}","overview":{{"total_athena_events":{len(athena)}}}}}'
                inside = f',"per_account":[{one}]' if int(day) % 2 else ""
                members = {
                    "summary.json": f'{{"overview":{{"total_athena_events":{len(athena)}}}{inside}}}',
                    "athena_events.json": "[" + ",".join(athena) + "]",
                    "s3_events.json": "[" + ",\n ".join(store_rows) + "]",
                    "per_account_summary.json": f"[{one}]",
                }
                write(f"{account}-{day}.zip", members)
                if int(account) % 6 == 1:
                    write(f"{account}-{day}-bad.zip", {"athena_events.json": "[" + ",".join(athena[:3])})
                if int(account) % 6 == 2:
                    with system.open_output_stream(f"{place}/{account}-{day}-cut.zip") as out:
                        out.write(b"PK\x03\x04 ends early")
            yield pd.DataFrame({"written": [len(batch)]})

    for_workers(grouped).mapInPandas(pack, "written long").agg(F.sum("written")).collect()
    return root


@query
def read_export_bundles(spark, sf):
    """All five tables of the bundles, a row of each as (kind, id, detail)."""
    index = sources.bundle_index(spark, _write_bundle_files(spark, sf))
    members = store_table(sources.read_indexed_members(index), "bundle-members")
    tables = sources.read_export_bundles(members)
    name = F.substring_index("file", "/", -1)

    def rows(table, kind, key, *detail):
        parts = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in detail)
        return tables[table].select(F.lit(kind).alias("kind"), key.alias("id"), F.concat_ws("|", *parts).alias("detail"))

    return (
        rows("athena_events", "athena", F.col("event_id"), "workgroup", "status", "query_string")
        .unionByName(rows("s3_events", "s3", F.col("event_id"), "event_name", "bucket", "key", "bytes_transferred", "extra_bytes_in", "extra_bytes_out"))
        .unionByName(rows("summaries", "summary", name, "overview.total_athena_events"))
        .unionByName(rows("per_account", "account", name, "source", "account_id", "overview.total_athena_events"))
        .unionByName(rows("errors", "error", name))
    )


@query
def read_execution_stats(spark, sf):
    return sources.read_execution_stats(view(spark, sf, "execution_stats"))


# --- sinks ---


@query
def write_workgroup_csv(spark, sf):
    path = work_dir(spark, "csv")
    sinks.write_workgroup_csv(us.workgroup_stats(collected(spark, sf).facts), path)
    schema = "workgroup string, query_count bigint, unique_users bigint, data_scanned_gb string"
    return spark.read.schema(schema).csv(path, header=True, escape='"')


@query
def write_summary_tables(spark, sf):
    root = work_dir(spark, "summary")
    path = sinks.dated_path(root)
    run = collected(spark, sf).stored(f"{root}/run")
    sections = summary_sections(run, settings={"analysis_mode": "batch"})
    sinks.write_summary_tables(sections, path)
    out = None
    for name in sections:
        rows = spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("row_count"))
        part = rows.select(F.lit(name).alias("section"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


@query
def write_event_tables(spark, sf):
    path = work_dir(spark, "events")
    sinks.write_event_tables(collected(spark, sf).events, path)
    rows = spark.read.parquet(path)
    return rows.groupBy(F.col("event_date").cast("string").alias("event_date")).agg(
        F.count(F.lit(1)).alias("event_count")
    )


@query
def workgroup_report_lines(spark, sf):
    facts = collected(spark, sf).facts
    types = us.query_type_map(us.workgroup_query_types(facts))
    return sinks.workgroup_report_lines(us.workgroup_stats(facts), types)


@query
def metric_log_lines(spark, sf):
    run = collected(spark, sf)
    return sinks.metric_log_lines(_overview(run), us.workgroup_stats(run.facts))


# --- filters ---


@query
def route_events(spark, sf):
    return ev.route_events(raw_audit(spark, sf)).select("eventID", "eventName", "route")


@query
def workgroup_allow_list(spark, sf):
    return ev.workgroup_allow_list(audit_events(spark, sf), ALLOWED).select(
        "event_id", "event_name", "workgroup"
    )


@query
def skipped_workgroups(spark, sf):
    return ev.skipped_workgroups(audit_events(spark, sf), ALLOWED)


@query
def bucket_filter(spark, sf):
    return ev.bucket_filter(store(spark, sf)).select("event_id", "bucket")


@query
def skipped_buckets(spark, sf):
    return ev.skipped_buckets(store(spark, sf))


@query
def time_range_filter(spark, sf):
    return ev.time_range_filter(usage(spark, sf), PERIOD).select("event_id", "event_time")


@query
def active_member_accounts(spark, sf):
    return ac.active_member_accounts(accounts(spark, sf), LOCAL_ACCOUNT)


@query
def valid_account_ids(spark, sf):
    supplier = spark.read.parquet(f"{sf}/supplier.parquet")
    key = F.col("s_suppkey")
    padded = F.lpad(key.cast("string"), 12, "0")
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("  "), padded, F.lit(" , "), key.cast("string")))
        .when(key % 4 == 1, F.concat(padded, F.lit("\n# note\n\n"), F.lit("x"), padded))
        .when(key % 4 == 2, F.concat(F.lit("# "), padded))
        .otherwise(F.concat(padded, F.lit(",,")))
    )
    return ac.valid_account_ids(supplier.select(text.alias("text")), "000000000007")


@query
def positive_measures(spark, sf):
    return ev.positive_measures(log(spark, sf), "execution_time_ms").select(
        "event_id", "execution_time_ms"
    )


# --- projections ---


@query
def normalize_athena_events(spark, sf):
    return audit_events(spark, sf).drop("request_parameters", "response_elements")


@query
def normalize_s3_events(spark, sf):
    return store_audit(spark, sf).select(
        "event_id", "event_name", "event_time", "bucket", "key", "user_id", "account_id"
    )


@query
def user_id(spark, sf):
    rows = view(spark, sf, "audit_flat")
    return rows.select("event_id", "event_name", fn.user_id("user_arn", "principal_id").alias("user_id"))


@query
def query_database(spark, sf):
    rows = view(spark, sf, "audit_flat").filter("event_name = 'StartQueryExecution'")
    return rows.select("event_id", ev.query_database("db").alias("database"))


@query
def classify_query(spark, sf):
    return log(spark, sf).select("event_id", fn.classify_query("query_string").alias("query_type"))


@query
def extract_tables(spark, sf):
    return log(spark, sf).select("event_id", fn.extract_tables("query_string").alias("tables"))


@query
def table_references(spark, sf):
    return us.table_references(collected(spark, sf).facts)


@query
def query_fingerprint(spark, sf):
    return log(spark, sf).select("event_id", fn.query_fingerprint("query_string").alias("pattern_hash"))


@query
def sanitize_query(spark, sf):
    return log(spark, sf).select("event_id", fn.sanitize_query("query_string").alias("text"))


@query
def object_prefix(spark, sf):
    return store(spark, sf).select("event_id", fn.object_prefix("key").alias("prefix"))


@query
def s3_operation(spark, sf):
    return store(spark, sf).select("event_id", fn.s3_operation("event_name").alias("operation"))


@query
def hour_key(spark, sf):
    return log(spark, sf).select("event_id", fn.hour_key("event_time").alias("hour"))


@query
def day_key(spark, sf):
    return log(spark, sf).select("event_id", fn.day_key("event_time").alias("day"))


@query
def minute_key(spark, sf):
    return log(spark, sf).select("event_id", fn.minute_key("event_time").alias("minute"))


@query
def parse_event_time(spark, sf):
    rows = view(spark, sf, "audit_flat")
    return rows.select("event_id", "event_name", fn.parse_event_time("event_time_text").alias("event_time"))


@query
def sql_features(spark, sf):
    return classified(spark, sf).select("event_id", "features")


@query
def query_complexity(spark, sf):
    c = F.col("complexity")
    names = (
        "join_count", "cte_count", "subquery_count", "union_count", "has_group_by",
        "has_aggregation", "potential_missing_group_by",
    )
    return classified(spark, sf).select("event_id", *(c[name].alias(name) for name in names))


@query
def ddl_operation(spark, sf):
    rows = classified(spark, sf).filter("ddl IS NOT NULL")
    return rows.select("event_id", F.col("ddl.type").alias("ddl_type"), "ddl.object", "ddl.hour")


@query
def partition_usage(spark, sf):
    return classified(spark, sf).select("event_id", "partitions.*")


@query
def long_running_class(spark, sf):
    return ql.long_running_queries(log(spark, sf)).select(
        "event_id", "long_class", "execution_time_min", "query_preview"
    )


@query
def migration_flags(spark, sf):
    return classified(spark, sf).select("event_id", "flags")


@query
def error_class(spark, sf):
    rows = log(spark, sf).filter("status = 'FAILED'")
    return rows.select("event_id", fn.error_class("error_message").alias("error_type"))


@query
def execution_time_bucket(spark, sf):
    rows = log(spark, sf)
    return rows.select("event_id", fn.execution_time_bucket("execution_time_ms").alias("bucket"))


@query
def format_bytes(spark, sf):
    return log(spark, sf).select("event_id", fn.format_bytes("data_scanned").alias("size"))


@query
def pct_of_total(spark, sf):
    counts = us.query_type_counts(collected(spark, sf).facts)
    return rk.with_share(counts, "query_count")


@query
def truncate_preview(spark, sf):
    return log(spark, sf).select(
        "event_id",
        fn.truncate_preview("query_string", 50, "...").alias("preview"),
        fn.truncate_preview("query_string", 30).alias("head"),
    )


@query
def feature_notes(spark, sf):
    return ql.feature_notes(texts(spark, sf))


# --- deduplication and joins ---


@query
def dedupe_events(spark, sf):
    return ev.dedupe_events(audit_events(spark, sf)).select("event_id", "event_name", "event_time")


@query
def query_starts(spark, sf):
    return collected(spark, sf).starts


@query
def enrich_queries(spark, sf):
    return collected(spark, sf).enriched


@query
def query_facts(spark, sf):
    return collected(spark, sf).facts


@query
def stats_without_start(spark, sf):
    stats = sources.read_execution_stats(view(spark, sf, "execution_stats"))
    return fc.stats_without_start(stats, collected(spark, sf).starts)


@query
def exclude_local_account(spark, sf):
    return ac.exclude_local_account(accounts(spark, sf), LOCAL_ACCOUNT)


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    errors = view(spark, sf, "account_errors")
    return ac.account_coverage(accounts(spark, sf).select("account_id"), overviews(spark, sf), errors)


@query
def account_coverage(spark, sf):
    return coverage(spark, sf).select(
        "account_id",
        "total_athena_events",
        "queries_fetched_from_athena",
        "unique_users",
        "unique_workgroups",
        "status",
    )


@query
def prefer_non_empty(spark, sf):
    rows = usage(spark, sf)
    even = F.col("id") % 2 == 0
    doubled = rows.select(
        "event_id",
        F.when(even, F.col("query_string")).otherwise("").alias("query_string"),
        F.when(~even, F.col("query_string")).alias("query"),
        F.when(~even, F.col("query_execution_id")).alias("query_execution_id"),
        F.when(even, F.col("query_execution_id")).alias("query_id"),
        F.when(even, F.col("workgroup")).otherwise("").alias("workgroup"),
        F.col("workgroup").alias("work_group"),
        F.when(even, F.col("data_scanned_bytes")).otherwise(0).alias("data_scanned_bytes"),
        F.when(~even, F.col("data_scanned_bytes")).alias("data_scanned_in_bytes"),
        F.when(even, F.col("error_message")).alias("error_message"),
        F.col("error_message").alias("state_change_reason"),
    )
    return ql.prefer_fields(doubled)


# --- aggregates over the audit log ---


@query
def workgroup_stats(spark, sf):
    return us.workgroup_stats(collected(spark, sf).facts)


@query
def workgroup_query_types(spark, sf):
    return us.workgroup_query_types(collected(spark, sf).facts)


@query
def polled_data_scanned(spark, sf):
    return fc.polled_data_scanned(collected(spark, sf).events)


@query
def user_activity(spark, sf):
    return us.user_activity(collected(spark, sf).events)


@query
def user_scope(spark, sf):
    return us.user_scope(collected(spark, sf).facts)


@query
def user_first_last_seen(spark, sf):
    return us.user_first_last_seen(log(spark, sf))


@query
def database_stats(spark, sf):
    return us.database_stats(collected(spark, sf).facts)


@query
def query_patterns(spark, sf):
    return us.query_patterns(collected(spark, sf).facts)


@query
def pattern_examples(spark, sf):
    return us.pattern_examples(collected(spark, sf).facts)


@query
def s3_bucket_stats(spark, sf):
    return so.s3_bucket_stats(store(spark, sf))


@query
def s3_bucket_bytes(spark, sf):
    return so.s3_bucket_bytes(store(spark, sf))


@query
def s3_totals(spark, sf):
    return so.s3_totals(store(spark, sf))


@query
def object_size_stats(spark, sf):
    return so.object_size_stats(store(spark, sf))


@query
def hourly_counts(spark, sf):
    return ql.hourly_counts(collected(spark, sf).events)


@query
def daily_counts(spark, sf):
    return ql.daily_counts(log(spark, sf))


@query
def minute_concurrency(spark, sf):
    return ql.minute_concurrency(log(spark, sf))


@query
def peak_concurrency(spark, sf):
    return ql.peak_concurrency(log(spark, sf))


@query
def query_type_counts(spark, sf):
    return us.query_type_counts(collected(spark, sf).facts)


# --- aggregates over the query log ---


@query
def sql_feature_counts(spark, sf):
    return ql.sql_feature_counts(texts(spark, sf))


@query
def sql_feature_examples(spark, sf):
    return ql.sql_feature_examples(classified(spark, sf))


@query
def join_type_counts(spark, sf):
    return ql.join_type_counts(texts(spark, sf))


@query
def complexity_totals(spark, sf):
    return ql.complexity_totals(texts(spark, sf))


@query
def high_complexity_queries(spark, sf):
    return ql.high_complexity_queries(classified(spark, sf))


@query
def ddl_by_type(spark, sf):
    return ql.ddl_by_type(classified(spark, sf))


@query
def ddl_by_hour(spark, sf):
    return ql.ddl_by_hour(classified(spark, sf))


@query
def ddl_by_user(spark, sf):
    return ql.ddl_by_user(classified(spark, sf))


@query
def ddl_by_table(spark, sf):
    return ql.ddl_by_table(classified(spark, sf))


@query
def partition_column_counts(spark, sf):
    return ql.partition_column_counts(texts(spark, sf))


@query
def partition_filter_totals(spark, sf):
    return ql.partition_filter_totals(texts(spark, sf))


@query
def status_counts(spark, sf):
    return ql.status_counts(log(spark, sf))


@query
def failure_rate(spark, sf):
    return ql.failure_rate(log(spark, sf))


@query
def error_type_counts(spark, sf):
    return ql.error_type_counts(log(spark, sf))


@query
def error_examples(spark, sf):
    return ql.error_examples(log(spark, sf))


@query
def execution_time_histogram(spark, sf):
    return ql.execution_time_histogram(log(spark, sf))


@query
def execution_time_stats(spark, sf):
    return ql.execution_time_stats(log(spark, sf))


@query
def data_scanned_by_user(spark, sf):
    return ql.data_scanned_by_user(log(spark, sf))


@query
def data_scanned_by_workgroup(spark, sf):
    return ql.data_scanned_by_workgroup(log(spark, sf))


@query
def data_scanned_stats(spark, sf):
    return ql.data_scanned_stats(log(spark, sf))


@query
def long_running_totals(spark, sf):
    return ql.long_running_totals(log(spark, sf))


@query
def migration_flag_counts(spark, sf):
    return ql.migration_flag_counts(texts(spark, sf))


@query
def migration_flag_examples(spark, sf):
    return ql.migration_flag_examples(classified(spark, sf))


@query
def analysis_period(spark, sf):
    return ql.analysis_period(log(spark, sf), store(spark, sf))


@query
def avg_queries_per_day(spark, sf):
    rows = log(spark, sf)
    return ql.avg_queries_per_day(rows, rows, store(spark, sf))


def _overview(run: Collected) -> DataFrame:
    return ov.overview(
        run.events,
        run.store_events,
        run.starts,
        run.facts,
        run.skipped_workgroups,
        run.skipped_buckets,
    )


@query
def overview(spark, sf):
    return _overview(collected(spark, sf))


@query
def per_account_overview(spark, sf):
    return overviews(spark, sf)


@query
def account_rollup(spark, sf):
    run = collected(spark, sf)
    return ov.account_rollup(run.facts, run.events, run.store_events)


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Summary documents as hourly runs export them: one per account, hour and
    thousand source rows, so that none grows with the tables. A document holds
    one section here; merging does not care."""
    rows = ql.query_log(view(spark, sf, "usage_row")).select(
        "account_id",
        "user_id",
        "workgroup",
        "db",
        "data_scanned",
        "execution_time_ms",
        fn.hour_key("event_time").alias("hour"),
        fn.classify_query("query_string").alias("kind"),
        fn.query_fingerprint("query_string").alias("hash"),
        fn.sanitize_query("query_string").alias("example"),
        fn.extract_tables("query_string").alias("tables"),
        F.floor(F.col("id") / 1000).alias("part"),
    )
    objects = so.store_operations(store(spark, sf)).select(
        "account_id", "user_id", "bucket", "operation", "bytes_in", "bytes_out",
        fn.hour_key("event_time").alias("hour"), fn.object_prefix("key").alias("prefix"), F.floor(F.col("id") / 1000).alias("part"),
    )
    run = ["account_id", "hour", "part"]
    one = F.count(F.lit(1))
    # A run holds at most a thousand rows; dealt by run, entries and documents need no further shuffle.
    rows, objects = rows.repartition(*run), objects.repartition(*run)

    def every(column: str) -> Column:
        return F.sort_array(F.collect_set(column))

    def document(section: str, entries: DataFrame) -> DataFrame:
        """Fold (run, name, entry) rows to one JSON document per run."""
        whole = entries.groupBy(*run).agg(
            F.map_from_entries(F.collect_list(F.struct("name", "entry"))).alias(section)
        )
        return whole.select(F.concat_ws("-", *run).alias("file"), F.to_json(F.struct(section)).alias("body"))

    def counted(section: str, key: str, source: DataFrame = rows, **fields: Column) -> DataFrame:
        folded = source.groupBy(*run, F.col(key).alias("name")).agg(*(c.alias(n) for n, c in fields.items()))
        return document(section, folded.select(*run, "name", F.struct(*fields).alias("entry")))

    tables = F.array_distinct(F.flatten(F.collect_list("tables")))
    groups = (
        rows.groupBy(*run, F.col("workgroup").alias("name"), "kind")
        .agg(one.alias("n"), F.sum("data_scanned").alias("bytes"), every("user_id").alias("users"))
        .groupBy(*run, "name")
        .agg(
            F.struct(
                F.sum("n").alias("query_count"),
                F.array_distinct(F.flatten(F.collect_list("users"))).alias("users"),
                F.sum("bytes").alias("total_data_scanned"),
                F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("query_types"),
            ).alias("entry")
        )
    )
    hours = rows.groupBy(*run, F.col("hour").alias("name")).agg(one.alias("entry"))
    patterns = counted(
        "query_patterns", "hash", count=one, users=every("user_id"), workgroups=every("workgroup"), databases=every("db"),
        tables=tables, examples=F.slice(every("example"), 1, 5), total_data_scanned=F.sum("data_scanned"),
        total_execution_time_ms=F.sum("execution_time_ms"),
    )
    operation = F.col("operation")
    buckets = counted(
        "s3_bucket_stats", "bucket", objects, get_count=F.count_if(operation == "get"), put_count=F.count_if(operation == "put"),
        list_count=F.count_if(operation == "list"), bytes_in=F.sum("bytes_in"), bytes_out=F.sum("bytes_out"),
        users=every("user_id"), prefixes=every("prefix"),
    )
    documents = (
        document("workgroup_stats", groups)
        .unionByName(counted("user_stats", "user_id", query_count=one, workgroups=every("workgroup"), databases=every("db")))
        .unionByName(counted("database_stats", "db", query_count=one, users=every("user_id"), tables=tables))
        .unionByName(patterns)
        .unionByName(buckets)
        .unionByName(document("hourly_query_counts", hours.select(*run, "name", "entry")))
    )
    stored = store_table(documents, "summaries")
    return stored.select("file", F.from_json("body", schemas.SUMMARY).alias("s")).select("file", "s.*")


@query
def merge_export_summaries(spark, sf):
    return ov.merge_export_summaries(_summaries(spark, sf))


@query
def merge_stored_summaries(spark, sf):
    """Each day's summaries are folded and stored by themselves; the merge reads the folds."""
    path = work_dir(spark, "summary-cells")
    dated = _summaries(spark, sf).withColumn("day", F.regexp_extract("file", r"\d{4}-\d{2}-\d{2}", 0))
    for late in (False, True):
        some = dated.filter((F.col("day") >= "2024-01-16") == F.lit(late))
        sinks.write_summary_cells(ov.fold_cells(ov.summary_cells(some, "day"), "day"), path)
    return ov.merge_cells(spark.read.parquet(path))


@query
def merge_pattern_examples(spark, sf):
    return ov.merge_pattern_examples(_summaries(spark, sf))


@query
def summary_example_tags(spark, sf):
    return ov.summary_example_tags(_summaries(spark, sf))


@query
def run_outcome(spark, sf):
    return ac.run_outcome(coverage(spark, sf))


@query
def readiness_score(spark, sf):
    return rd.readiness_score(log(spark, sf)).withColumn(
        "considerations", F.array_join("considerations", " | ")
    )


@query
def recommendations(spark, sf):
    return rd.recommendations(log(spark, sf), store(spark, sf))


# --- ranked tables ---


@query
def top_workgroups_by_queries(spark, sf):
    return us.top_workgroups_by_queries(collected(spark, sf).facts)


@query
def top_workgroups_by_data(spark, sf):
    return us.top_workgroups_by_data(collected(spark, sf).facts)


@query
def top_types_per_workgroup(spark, sf):
    return us.top_types_per_workgroup(collected(spark, sf).facts)


@query
def top_users(spark, sf):
    run = collected(spark, sf)
    return us.top_users(run.events, run.facts)


@query
def top_databases(spark, sf):
    return us.top_databases(collected(spark, sf).facts)


@query
def ranked_patterns(spark, sf):
    return us.ranked_patterns(collected(spark, sf).facts).select(
        "rank", "pattern_hash", "query_count", "unique_users"
    )


@query
def top_patterns(spark, sf):
    return us.top_patterns(collected(spark, sf).facts)


@query
def top_buckets(spark, sf):
    return so.top_buckets(store(spark, sf))


@query
def last_n_days(spark, sf):
    return rk.last_n_days(ql.daily_counts(log(spark, sf)), 14)


@query
def top_features(spark, sf):
    return ql.top_features(texts(spark, sf), 12)


@query
def query_types_top8_other(spark, sf):
    return rk.top_k_and_other(
        us.query_type_counts(collected(spark, sf).facts), "query_type", "query_count", 8
    )


@query
def join_types_ranked(spark, sf):
    return ql.join_types_ranked(texts(spark, sf))


@query
def first_high_complexity(spark, sf):
    return ql.first_high_complexity(classified(spark, sf))


@query
def ddl_samples_by_type(spark, sf):
    return ql.ddl_samples_by_type(classified(spark, sf))


@query
def top_ddl_users(spark, sf):
    return ql.top_ddl_users(classified(spark, sf))


@query
def longest_queries(spark, sf):
    return ql.longest_queries(log(spark, sf))


@query
def top_scanners(spark, sf):
    return ql.top_scanners(log(spark, sf))


@query
def errors_ranked(spark, sf):
    return ql.errors_ranked(log(spark, sf))


@query
def flags_ranked(spark, sf):
    return ql.flags_ranked(classified(spark, sf))


# --- set operations ---


@query
def union_accounts(spark, sf):
    events = collected(spark, sf).events
    local = events.filter(F.col("account_id") == LOCAL_ACCOUNT)
    others = events.filter(F.col("account_id") != LOCAL_ACCOUNT)
    return local.unionByName(others).select("event_id", "event_name", "account_id")


@query
def union_exports(spark, sf):
    """Two overlapping exports: an event in both is counted once."""
    rows = view(spark, sf, "usage_row")
    first = rows.filter("event_time < TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    second = rows.filter("event_time >= TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    return ev.dedupe_events(first.unionByName(second)).select("event_id", "event_time")


@query
def distinct_members(spark, sf):
    return mb.distinct_members(
        collected(spark, sf).facts, ["workgroup"], {"user": "user_id", "database": "database"}
    )


@query
def per_account_first_source(spark, sf):
    tables = sources.read_export_bundles(_bundle_members(spark, sf, "per-account", True))
    rows = ov.per_account_first_source(tables["per_account"])
    return rows.select("file", "source", "account_id", "overview.total_athena_events")


# --- streaming ---


def _stream(spark: SparkSession, sf: str, name: str = "usage_log") -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    arriving = st.read_stream(spark, sf, schema, pattern="events.parquet")
    return view(spark, sf, name, events=arriving)


BATCHES = 2
FILE_ROWS = 500_000


def _batches(spark: SparkSession, sf: str, root: str) -> DataFrame:
    """The log as files that arrive out of order, in two batches; a larger log has more files
    a batch, not larger ones."""
    rows = view(spark, sf, "usage_log")
    files = 1 + (rows.count() - 1) // (BATCHES * FILE_ROWS)
    rows.repartition(BATCHES * files).write.parquet(f"{root}/arriving")
    return st.read_stream(spark, f"{root}/arriving", rows.schema, files_per_batch=files)


def _merged_stream(spark: SparkSession, sf: str, name: str, **summaries) -> st.MergedTable:
    """The arriving files merged batch by batch into one deduplicated table."""
    root = work_dir(spark, name)
    arriving = _batches(spark, sf, root).withColumn("user_id", fn.user_id("user_arn", F.lit("")))
    merged = st.MergedTable(spark, f"{root}/merged", arriving.schema, summaries, buckets=1)
    merged.follow(arriving, f"{root}/cp").awaitTermination()
    return merged


@query
def stream_events(spark, sf):
    root = work_dir(spark, "stream-events")
    rows = _stream(spark, sf).select("event_id", "event_time", "workgroup", "status")
    st.run_to_files(rows, f"{root}/events", f"{root}/cp").awaitTermination()
    return spark.read.parquet(f"{root}/events")


@query
def stream_dedupe(spark, sf):
    return _merged_stream(spark, sf, "stream-dedupe").rows().select("event_id", "event_time")


@query
def stream_hourly_counts(spark, sf):
    hours = _merged_stream(spark, sf, "stream-hours", hours=st.counts_by("1 hour")).summary("hours")
    totals = hours.groupBy("window_start").agg(F.sum("event_count").alias("event_count"))
    return totals.select(fn.hour_key("window_start").alias("hour"), "event_count")


@query
def stream_minute_peak(spark, sf):
    minutes = _merged_stream(spark, sf, "stream-minutes", minutes=st.counts_by("1 minute")).summary("minutes")
    totals = minutes.groupBy("window_start").agg(F.sum("event_count").alias("event_count"))
    return totals.agg(F.max("event_count").alias("peak_concurrency"))


@query
def stream_workgroup_stats(spark, sf):
    cells = st.cells_by(["workgroup", "user_id"], {"data_scanned": "data_scanned_bytes"})
    users = _merged_stream(spark, sf, "stream-groups", users=cells).summary("users")
    return users.groupBy("workgroup").agg(
        F.sum("query_count").alias("query_count"), F.sum("data_scanned").alias("data_scanned"), F.countDistinct("user_id").alias("unique_users")
    )


@query
def stream_enrich(spark, sf):
    """Starts and statistics arrive in three files each; every fifth statistics row comes after
    the horizon and is put in by the correction. The last files move both watermarks on."""
    root = work_dir(spark, "stream-enrich")
    late = F.col("id") % 5 == 0
    starts = view(spark, sf, "usage_row").withColumns({"user_id": fn.user_id("user_arn", F.lit("")), "database": F.col("db")})
    times = starts.select("id", "query_execution_id", "event_time")
    rows = sources.read_execution_stats(view(spark, sf, "execution_stats")).join(times, "query_execution_id", "left")
    rows = rows.withColumn("stats_time", F.coalesce("event_time", F.lit("2024-01-01").cast("timestamp_ntz")) + F.expr("INTERVAL 10 MINUTES"))
    rows = rows.withColumn("stats_time", F.when(late, F.col("stats_time") + F.expr("INTERVAL 10 DAYS")).otherwise(F.col("stats_time")))
    rows = store_table(rows, "statistics-rows")
    half = "< TIMESTAMP_NTZ '2024-01-16 00:00:00'"
    end = F.lit("2030-01-01").cast("timestamp_ntz")
    early, then = (F.expr(f"event_time {half}"), F.expr(f"stats_time {half}"))
    for part in (starts.filter(early), starts.filter(~early), starts.limit(1).withColumns({"query_execution_id": F.lit("end"), "event_time": end})):
        part.coalesce(1).write.mode("append").parquet(f"{root}/starts")
    for part in (rows.filter(then), rows.filter(~then), rows.limit(1).withColumns({"query_execution_id": F.lit("end"), "stats_time": end})):
        part.coalesce(1).write.mode("append").parquet(f"{root}/stats")

    def arriving(name, schema):
        return st.read_stream(spark, f"{root}/{name}", schema, files_per_batch=1)

    facts = st.enrich_arriving(arriving("starts", starts.schema), arriving("stats", rows.schema))
    st.run_to_files(facts, f"{root}/facts", f"{root}/cp").awaitTermination()
    seen = spark.read.parquet(f"{root}/stats").filter("query_execution_id <> 'end'")
    done = st.corrected(spark.read.parquet(f"{root}/facts"), seen).filter("query_execution_id <> 'end'")
    return done.select("event_id", "query_execution_id", "query", "workgroup", "database", "status", "data_scanned")
