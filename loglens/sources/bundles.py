"""Export bundles: zip files with a summary and two event lists."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..session import for_workers

MEMBERS = ("summary.json", "athena_events.json", "s3_events.json", "per_account_summary.json")
MEMBER_ROW = "file string, member string, position bigint, body string, error string"
_BATCH_ROWS = 1000


def _unzip(batches: Iterator) -> Iterator:
    """Members as rows: a list gives one row per item, another value one row.

    A bundle that fails gives one row with the error; the others go on.
    """
    import pandas as pd

    columns = ["file", "member", "position", "body", "error"]

    def rows(path: str, content: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as bundle:
                names = set(bundle.namelist())
                for member in MEMBERS:
                    if member not in names:
                        continue
                    value = json.loads(bundle.read(member).decode("utf-8"))
                    items = value if isinstance(value, list) else [value]
                    for position, item in enumerate(items):
                        yield path, member, position, json.dumps(item), None
        except Exception as error:  # a broken bundle must not stop the others
            yield path, None, None, None, f"Error processing {path}: {error}"

    for batch in batches:
        pending = []
        for path, content in zip(batch["path"], batch["content"]):
            for row in rows(path, content):
                pending.append(row)
                if len(pending) >= _BATCH_ROWS:
                    yield pd.DataFrame(pending, columns=columns)
                    pending = []
        if pending:
            yield pd.DataFrame(pending, columns=columns)


def read_bundle_members(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, member, position, body, error) for every zip below the path."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.zip")
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return unzip_members(files)


def unzip_members(files: DataFrame) -> DataFrame:
    """Members of zips held as rows (path, content)."""
    return for_workers(files).select("path", "content").mapInPandas(_unzip, MEMBER_ROW)


def read_export_bundles(members: DataFrame) -> dict[str, DataFrame]:
    """Typed tables over bundle members: summaries, the two event lists, the
    per-account rows of both origins, and the errors.

    Each table reads the members again; store them first (``write.parquet``)
    where more than one table is used.
    """

    def parsed(member: str, schema) -> DataFrame:
        rows = members.filter((F.col("member") == member) & F.col("error").isNull())
        return rows.select("file", "position", F.from_json("body", schema).alias("_v"))

    summaries = parsed("summary.json", schemas.SUMMARY).select("file", "_v.*")
    nested = summaries.select("file", F.posexplode("per_account").alias("position", "_v"))
    separate = parsed("per_account_summary.json", schemas.ACCOUNT_SUMMARY)

    def account_rows(df: DataFrame, source: str) -> DataFrame:
        return df.select("file", F.lit(source).alias("source"), "position", "_v.*")

    return {
        "summaries": summaries,
        "athena_events": parsed("athena_events.json", schemas.LOG_EVENT).select("file", "_v.*"),
        "s3_events": parsed("s3_events.json", schemas.STORE_EVENT).select(
            "file",
            "_v.*",
            F.col("_v.additionalEventData.bytesTransferredIn").alias("extra_bytes_in"),
            F.col("_v.additionalEventData.bytesTransferredOut").alias("extra_bytes_out"),
        ).drop("additionalEventData"),
        "per_account": account_rows(nested, "summary").unionByName(
            account_rows(separate, "member")
        ),
        "errors": members.filter(F.col("error").isNotNull()).select("file", "error"),
    }
