"""Gzip JSON audit files, pruned by date folder, for one or all accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..operators.events import Period

# Folder layouts; ``{day}`` becomes the days of the period.
SINGLE_LAYOUT = "{root}/AWSLogs/{account}/CloudTrail/{region}/{day}/"
ORG_LAYOUT = "{root}/AWSLogs/{organization}/{account}/CloudTrail/{region}/{day}/"


def audit_paths(
    root: str,
    period: Period,
    layout: str = SINGLE_LAYOUT,
    day_format: str = "%Y/%m/%d",
    account: str = "*",
    region: str = "*",
    organization: str = "",
) -> str | None:
    """One glob that matches the day folders of the period, of every account
    when ``account`` is '*'. None when the layout needs an organization and
    none is set. The days are at most 91 alternatives, so the driver lists
    only folders inside the period, whatever the number of accounts."""
    if "{organization}" in layout and not organization:
        return None
    days = ",".join(day.strftime(day_format) for day in period.days())
    return layout.format(
        root=root.rstrip("/"),
        account=account,
        region=region,
        organization=organization,
        day="{" + days + "}",
    )


def _files(spark: SparkSession, path: str | list[str], max_bytes: int | None) -> DataFrame:
    files = (
        spark.read.schema(schemas.AUDIT_FILE)
        .option("multiLine", True)
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .option("recursiveFileLookup", True)
        .json(path)
    )
    return files if max_bytes is None else files.filter(F.col("_metadata.file_size") <= max_bytes)


def read_audit_files(
    spark: SparkSession,
    path: str | list[str],
    max_bytes: int | None = None,
    account_pattern: str | None = None,
) -> DataFrame:
    """One row per record. Files that can't be read give none, nor do files over
    ``max_bytes`` where that is set; ``audit_file_problems`` lists both. A gzip
    file is one task; the service writes them small.

    ``account_pattern`` takes the account from the path by its first group.
    """
    files = _files(spark, path, max_bytes)
    columns = [F.explode("Records").alias("record")]
    if account_pattern:
        columns.append(F.regexp_extract("_metadata.file_path", account_pattern, 1).alias("account_id"))
    return files.select(*columns).select("record.*", *(["account_id"] if account_pattern else []))


def audit_file_problems(
    spark: SparkSession, path: str | list[str], max_bytes: int | None = None
) -> DataFrame:
    """path, size, problem of the files that ``read_audit_files`` has no record of because
    they are too large, or broken. A file with an empty list of records is fine."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", F.col("length").alias("size"))
    )
    good = (
        _files(spark, path, max_bytes).filter(F.col("Records").isNotNull())
        .select(F.col("_metadata.file_path").alias("path")).distinct()
    )
    too_large = F.col("size") > max_bytes if max_bytes is not None else F.lit(False)
    problem = F.when(too_large, "too large").otherwise("unreadable")
    return listed.join(good, "path", "left_anti").withColumn("problem", problem)


ORG_ACCOUNT = r"/AWSLogs/[^/]+/([^/]+)/CloudTrail/"


def read_org_audit_files(
    spark: SparkSession, root: str, period: Period, organization: str, region: str = "*"
) -> DataFrame | None:
    """All accounts of an organization in one scan, tagged with the account."""
    path = audit_paths(root, period, ORG_LAYOUT, region=region, organization=organization)
    return read_audit_files(spark, path, account_pattern=ORG_ACCOUNT) if path else None
