"""Audit files read once: records, and the files that give none, in one table.

The folders are listed without reading them; files are dealt to tasks by their bytes, many
small ones to a task; a task inflates a file piece by piece and cuts its list into records.
A file that is too large is not opened. Broken files give a row with what is wrong and none
of their records, as if they had been parsed whole. Spark's listing leaves out files of no
bytes, so those give no row at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..operators.events import Period
from ..session import for_workers, store_table
from .audit_files import ORG_ACCOUNT, ORG_LAYOUT, audit_paths
from .json_items import PIECE, items_of
from .zip_index import open_by_uri

SCAN = "path string, size bigint, position bigint, body string, problem string"
#: Characters of records held before a file has been seen to its end; larger files are read twice.
HOLD = 64 << 20
TASK_BYTES = 32 << 20


def inflated(file) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, or of a plain file, in pieces."""
    data = file.read(PIECE)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = file.read(PIECE)
        return
    inflate = zlib.decompressobj(31)
    while data:
        out = inflate.decompress(data, 8 * PIECE)
        yield out
        data = inflate.unconsumed_tail
        if inflate.eof:
            data = inflate.unused_data or file.read(PIECE)
            if not data.strip(b"\0"):
                return
            inflate = zlib.decompressobj(31)
        elif not data:
            data = file.read(PIECE)
    if not inflate.eof:
        raise EOFError("the file ends early")


def _records(open_file: Callable, path: str) -> Iterator[str]:
    """The records of a file once it is known to be whole."""
    held, size = [], 0
    with open_file(path) as file:
        for body in items_of(inflated(file), "Records"):
            size += len(body)
            if size <= HOLD:
                held.append(body)
    if size <= HOLD:
        yield from held
        return
    held = []
    with open_file(path) as file:
        yield from items_of(inflated(file), "Records")


def _scan(open_file: Callable, max_bytes: int | None, batches) -> Iterator:
    import pyarrow as pa

    names = [x.split()[0] for x in SCAN.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def rows(path, size):
        if max_bytes is not None and size > max_bytes:
            yield path, size, None, None, "too large"
            return
        try:
            for position, body in enumerate(_records(open_file, path)):
                yield path, size, position, body, None
        except Exception as error:  # one unreadable file must not stop the others
            yield path, size, None, None, f"unreadable: {error}"

    for batch in batches:
        out, held = [], 0
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for row in rows(path, size):
                out.append(row)
                held += len(row[3] or "")
                if held >= 8 * PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def scan_audit_files(
    spark: SparkSession,
    path: str | list[str],
    max_bytes: int | None = None,
    account_pattern: str | None = None,
    task_bytes: int = TASK_BYTES,
    open_file: Callable = open_by_uri,
) -> DataFrame:
    """path, size, problem (null for records), account_id (where a pattern takes it from the
    path) and record. Write it once to use both parts; or filter the part that is wanted."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
        .load(path).select("path", "length")
    )
    files = store_table(files, "audit-listing")
    wanted = files if max_bytes is None else files.filter(F.col("length") <= max_bytes)
    total = wanted.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, total // task_bytes, min(spark.sparkContext.defaultParallelism, files.count()))

    def run(batches):
        return _scan(open_file, max_bytes, batches)

    rows = for_workers(files).repartition(tasks, "path").mapInArrow(run, SCAN)
    account = [F.regexp_extract("path", account_pattern, 1).alias("account_id")] if account_pattern else []
    record = F.when(F.col("body").isNotNull(), F.from_json("body", schemas.RECORD)).alias("record")
    return rows.select("path", "size", "problem", *account, record)


def scan_org_audit_files(
    spark: SparkSession, root: str, period: Period, organization: str, region: str = "*", max_bytes: int | None = None
) -> DataFrame | None:
    """All accounts of an organization in one read, tagged with the account: records and
    problems. None where no organization is set."""
    path = audit_paths(root, period, ORG_LAYOUT, region=region, organization=organization)
    return scan_audit_files(spark, path, max_bytes, ORG_ACCOUNT) if path else None


def audit_records(scan: DataFrame) -> DataFrame:
    """The records of a scan, as ``read_audit_files`` gives them."""
    tags = [c for c in scan.columns if c == "account_id"]
    return scan.filter(F.col("problem").isNull()).select("record.*", *tags)


def audit_problems(scan: DataFrame) -> DataFrame:
    """The files of a scan that gave no records because of their size or state."""
    return scan.filter(F.col("problem").isNotNull()).drop("record")
