"""Helpers of the training-data operators: chunks of documents, packed texts, first-of-equals."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null id inside tasks; a null id comes before every other.
NO_ID = np.iinfo(np.int64).min
CHUNKS_PER_PARTITION = 4
CHUNK_BYTES = 16 << 20
PART_BYTES = 64 << 20
UNKNOWN_BYTES = 1 << 55


def expected_bytes(table: DataFrame) -> int:
    """Bytes Spark expects of a table; 0 where it can't tell (it then says some EB)."""
    expected = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return expected if expected < UNKNOWN_BYTES else 0


def chunk_count(spark: SparkSession, docs: DataFrame | None = None) -> int:
    """Chunks the documents are dealt into: a few for each shuffle partition, and more where
    the table's bytes ask for it, so that chunks grow in number and not in size."""
    by_partitions = CHUNKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(by_partitions, expected_bytes(docs) // CHUNK_BYTES if docs is not None else 0)


def part_count(docs: DataFrame) -> int:
    """Slots or shards: one for each shuffle partition, and more by the table's bytes."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), expected_bytes(docs) // PART_BYTES)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def freeing(body):
    """A function of (key, left, right) for applyInArrow, which gives memory back after each group."""

    def call(key, left, right):
        try:
            return body(key, left, right)
        finally:
            give_back()

    return call


def chunk_of(key: Column | str, chunks: int) -> Column:
    return F.pmod(F.hash(key), F.lit(chunks))


def with_chunks(docs: DataFrame, chunks: int, whole: bool = False) -> DataFrame:
    """doc_id and text, with the chunk of the doc_id; equal ids share a chunk. ``whole`` adds
    the other columns as one, so that they can't clash with names in use."""
    columns = [
        chunk_of(F.col("doc_id"), chunks).alias("chunk"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ]
    if whole:
        columns.append(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))
    return docs.select(*columns)


def result_type(docs: DataFrame, columns: str, whole: bool) -> T.StructType:
    """The schema of an operator's result; ``whole`` adds kept_text and the other columns."""
    schema = T.StructType.fromDDL(columns)
    if whole:
        row = T.StructType([f for f in docs.schema.fields if f.name != "text"])
        schema = schema.add("kept_text", "string").add("row", row)
    return schema


def rewritten(docs: DataFrame, result: DataFrame) -> DataFrame:
    """The table with kept_text in the place of its text (and of its length in n_chars)."""
    columns = []
    for c in docs.columns:
        value = F.col("kept_text") if c == "text" else F.col(f"row.`{c}`")
        if c == "n_chars":
            value = F.length("kept_text").cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return result.select(*columns)


def ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else ids(_one(column))


def id_array(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def packed(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array and the n + 1 offsets; null is empty."""
    array = _one(column) if isinstance(column, pa.ChunkedArray) else column
    array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    size = int(at[-1]) - int(at[0])
    return (np.frombuffer(data, np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)), at - at[0]


def spread(values: np.ndarray) -> np.ndarray:
    """A 64-bit mix of 64-bit numbers (wrapping)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct pair (of non-negative numbers below 2**31), and its count."""
    key = (a << 32) | b
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    number = np.empty(len(key), np.int64)
    number[order] = group
    return number, np.diff(np.append(np.flatnonzero(new), len(key)))


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def unblob(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """All values of a column of packed arrays, in row order."""
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def counts_of(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """How many values each packed array of a column holds."""
    return np.array([len(x) // width if x else 0 for x in column.to_pylist()], np.int64)


def not_first(rows: DataFrame, key: list[str], order: str, salts: int) -> DataFrame:
    """The rows of each key whose order value isn't the least (ties for the least are all first).

    A key with very many rows is ranked in two rounds: in each salt, then among the firsts of
    the salts, so no task holds more than a share of it.
    """
    by_salt = Window.partitionBy(*key, "salt").orderBy(F.col(order).asc_nulls_first())
    by_key = Window.partitionBy(*key).orderBy(F.col(order).asc_nulls_first())
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(order), F.lit(salts))).withColumn("place", F.rank().over(by_salt))
    firsts = salted.filter("place = 1").withColumn("place", F.rank().over(by_key))
    return salted.filter("place > 1").unionByName(firsts.filter("place > 1")).drop("salt", "place")


# --- words of packed texts ---

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = spread(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def parts(sizes: np.ndarray, most: int):
    """Slices of rows whose sizes sum to about ``most``; a larger row is alone."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text a mask holds."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(mask, offsets[full], dtype=np.int64)
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, step: int = 1 << 19):
    """A 64-bit hash of every word (run of bytes outside [\\x20\\x09-\\x0D]), the text it is
    in, and where it begins. Done in blocks, so that a long text needs little more memory."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    found: list[tuple[np.ndarray, np.ndarray]] = []
    a = 0
    while a < len(data):
        b = min(a + step, len(data))
        while b < len(data) and not (edge[b] or BLANK[data[b]]):  # end between words
            ahead = np.flatnonzero(edge[b : min(b + step, len(data))] | BLANK[data[b : b + step]])
            b = b + int(ahead[0]) if len(ahead) else min(b + step, len(data))
        part = data[a:b]
        solid = ~BLANK[part]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[a + 1 : b]
        at = np.flatnonzero(begins)
        if len(at):
            place = np.flatnonzero(solid)
            pos = place - at[np.cumsum(begins)[place] - 1]
            value = _TABLE[((pos & 63) << 8) | part[place]]
            far = np.flatnonzero(pos > 63)
            value[far] *= (2 * (pos[far] >> 6) + 1).astype(np.uint64)
            found.append((np.add.reduceat(value, np.flatnonzero(begins[place])), at + a))
        a = b
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, where = (np.concatenate(x) for x in zip(*found))
    return hashes, np.searchsorted(offsets, where, "right") - 1, where


def windows_of(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of so many words inside one text, and the place of their first."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    mixed = spread(hashes)
    for j in range(size):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += mixed[j : j + n]
    inside = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return spread(total[inside]), inside
