"""Zip bundles read member by member through their central directories.

``bundle_index`` lists the zips (without reading them) and reads only the directory at
the end of each: one row per member with its place and sizes. ``read_indexed_members``
gives every member to a task of its own share of bytes, which seeks to the member, inflates
it piece by piece and cuts a list into its items. No bundle is held whole, so bundles and
members may be of any size, and a large bundle is read by many tasks.

Ranged reads go through the file systems of Arrow (local, s3, hdfs, gs, abfs) or through
``open_file``, any function from a path to a seekable binary file.
"""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import for_workers, store_table
from .bundles import MEMBERS, MEMBER_ROW
from .json_items import PIECE, items_of

INDEX = "file string, member string, method int, start bigint, packed bigint, size bigint, checksum bigint, error string"
#: Members of this size or more are read twice, to be checked before their items are given.
HOLD = 64 << 20
TASK_BYTES = 64 << 20
_HEADER = struct.Struct("<4s5H3I2H")


def open_by_uri(path: str):
    """A seekable file of one of Arrow's file systems; Spark writes local paths as file:/…"""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", re.sub(r"^s3[an]:", "s3:", path)))
    return system.open_input_file(place)


def _problem(path: str, error: Exception) -> str:
    return f"Error processing {path}: {error}"


def _index(open_file: Callable, members: tuple[str, ...], batches) -> Iterator:
    import pyarrow as pa

    names = [x.split()[0] for x in INDEX.split(", ")]
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            try:
                with open_file(path) as file, zipfile.ZipFile(file) as bundle:
                    infos = {i.filename: i for i in bundle.infolist()}
                    found = [infos[m] for m in members if m in infos]
                    rows += [(path, i.filename, i.compress_type, i.header_offset, i.compress_size, i.file_size, i.CRC, None) for i in found]
            except Exception as error:  # a broken bundle must not stop the others
                rows.append((path, None, None, None, None, None, None, _problem(path, error)))
        columns = list(zip(*rows)) if rows else [()] * len(names)
        types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def bundle_index(
    spark: SparkSession, path: str | list[str], members: tuple[str, ...] = MEMBERS, open_file: Callable = open_by_uri
) -> DataFrame:
    """One row per member of every zip below the path; a bundle whose directory can't be read
    gives one row with the error. The listing leaves the contents where they are."""
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    )

    def run(batches):
        return _index(open_file, members, batches)

    return for_workers(listed).select("path").mapInArrow(run, INDEX)


def _pieces(file, method: int, start: int, packed: int, checksum: int) -> Iterator[bytes]:
    """The bytes of a member, inflated piece by piece and checked at the end."""
    file.seek(start)
    header = _HEADER.unpack(file.read(_HEADER.size))
    if header[0] != b"PK\x03\x04":
        raise zipfile.BadZipFile("bad magic number of a member")
    file.seek(start + _HEADER.size + header[9] + header[10])
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise NotImplementedError(f"compression method {method}")
    inflate = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
    crc = 0
    while packed:
        data = file.read(min(PIECE, packed))
        if not data:
            raise EOFError("the member ends early")
        packed -= len(data)
        while data:
            out = inflate.decompress(data, 8 * PIECE) if inflate else data
            data = inflate.unconsumed_tail if inflate else b""
            crc = zlib.crc32(out, crc)
            yield out
    if inflate:
        out = inflate.flush()
        crc = zlib.crc32(out, crc)
        yield out
    if crc != checksum:
        raise zipfile.BadZipFile("bad CRC-32 of a member")


def _read(open_file: Callable, batches) -> Iterator:
    import pyarrow as pa

    names = [x.split()[0] for x in MEMBER_ROW.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def rows(path, member, method, start, packed, size, checksum, error):
        if error is not None:
            yield path, None, None, None, error
            return
        try:
            with open_file(path) as file:
                def items():
                    return items_of(_pieces(file, method, start, packed, checksum))

                if size >= HOLD:
                    for _ in items():
                        pass
                for position, body in enumerate(items() if size >= HOLD else list(items())):
                    yield path, member, position, body, None
        except Exception as broken:  # a broken member must not stop the others
            yield path, member, None, None, _problem(path, broken)

    for batch in batches:
        out, held = [], 0
        for entry in zip(*(c.to_pylist() for c in batch.columns)):
            for row in rows(*entry):
                out.append(row)
                held += len(row[3] or "")
                if held >= 8 * PIECE:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)


def read_indexed_members(index: DataFrame, task_bytes: int = TASK_BYTES, open_file: Callable = open_by_uri) -> DataFrame:
    """(file, member, position, body, error): a row per item of every member. A member that is
    broken, or is no JSON, gives one row with the error and none of its items.

    The index is stored; its members are dealt to as many tasks as its packed bytes hold
    ``task_bytes``. (Text that is no JSON is held from where it stops being so.)
    """
    index = store_table(index, "bundle-index")
    total = index.agg(F.sum("packed")).first()[0] or 0
    spark = index.sparkSession
    tasks = max(1, total // task_bytes, min(spark.sparkContext.defaultParallelism, index.count()))
    dealt = index.repartition(tasks, "file", "member")

    def run(batches):
        return _read(open_file, batches)

    return for_workers(dealt).mapInArrow(run, MEMBER_ROW)
