"""Blocks of documents as word numbers, and the way of their distinct words through shards.

A block holds some MB of text as one row: the distinct words once, the most frequent first,
and the number of its word for every place of every text. Words that all documents share
are thus one entry a block. To learn something of each word, a block tells every shard its
distinct words in one row (``ask``); a shard answers in the same order, and the block puts
the answers of all shards together (``answers_in_order``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loglens.llm.common import blob, ids, part_count

BLOCK_BYTES = 8 << 20
#: owner and places are of the texts, whose words follow each other in ``codes``.
FOLDED = "block long, owner binary, places binary, codes binary, words binary, label string"
ASKED = "shard int, block long, label string, words binary"


def shards_for(docs: DataFrame) -> int:
    """Shards by the bytes Spark expects of the table, and not fewer than its partitions.
    A table whose size Spark can't tell (it then says some EB) gets one for each partition."""
    return part_count(docs)


def pack_codes(codes: np.ndarray) -> bytes:
    """Small numbers in a byte, others in three (five if there are very many), compressed."""
    if len(codes) and int(codes.max()) >= 192 + (64 << 16):
        return b"\1" + zstandard.compress(blob(codes.astype("<u4")))
    far = codes >= 192
    rest = codes[far] - 192
    first = codes.astype(np.uint8)
    first[far] = 192 + (rest >> 16)
    parts = [zstandard.compress(blob(x)) for x in (first, rest.astype("<u2"))]
    return b"\0" + len(parts[0]).to_bytes(8, "little") + b"".join(parts)


def unpack_codes(data: bytes) -> np.ndarray:
    if data[:1] == b"\1":
        return np.frombuffer(zstandard.decompress(data[1:]), "<u4").astype(np.int64)
    cut = 9 + int.from_bytes(data[1:9], "little")
    first = np.frombuffer(zstandard.decompress(data[9:cut]), np.uint8).astype(np.int64)
    far = np.flatnonzero(first >= 192)
    first[far] = 192 + ((first[far] - 192) << 16) + np.frombuffer(zstandard.decompress(data[cut:]), "<u2")
    return first


def planes(values: np.ndarray) -> bytes:
    """First bytes of all numbers, then second ones, ...: this compresses better."""
    size = values.dtype.itemsize
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T.tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), "<u4", len(words))
    return len(words).to_bytes(8, "little") + zstandard.compress(planes(sizes) + b"".join(words), 9)


def unpack_words(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:8], "little")
    raw = zstandard.decompress(data[8:])
    at = np.cumsum(unplanes(raw[: 4 * n], "<u4").astype(np.int64)).tolist() if n else []
    words = raw[4 * n :]
    return [words[a:b] for a, b in zip([0, *at], at)]


class _Open:
    """A block while it grows: numbers are given to words as they come."""

    def __init__(self):
        self.number: dict = {}
        self.owner: list[int] = []
        self.places: list[int] = []
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, owner: int, words: list, size: int) -> None:
        number = self.number
        for w in set(words).difference(number):
            number[w] = len(number)
        self.codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        self.owner.append(owner)
        self.places.append(len(words))
        self.size += size

    def row(self, block: int, label) -> tuple:
        codes = np.concatenate(self.codes)
        by_count = np.argsort(-np.bincount(codes, minlength=len(self.number)), kind="stable")
        rank = np.empty(len(by_count), np.int64)
        rank[by_count] = np.arange(len(by_count))
        names = list(self.number)
        words = [names[i] for i in by_count.tolist()]
        words = [w.encode() for w in words] if words and isinstance(words[0], str) else words
        owner, places = (blob(np.array(x, np.int64)) for x in (self.owner, self.places))
        return block, owner, places, pack_codes(rank[codes]), pack_words(words), label


def fold(batches: Iterable[pa.RecordBatch], split: Callable[[str], list]) -> Iterable[pa.RecordBatch]:
    """Blocks of (doc_id, text, label) rows; a block's texts have one label. A block is closed
    at ``BLOCK_BYTES`` of text, so a task holds that much for each label."""
    context = TaskContext.get()
    next_block = (context.partitionId() if context else 0) << 32
    names = [x.split()[0] for x in FOLDED.split(", ")]
    types = [pa.int64(), *[pa.binary()] * 4, pa.string()]
    open_blocks: dict = {}

    def closed(label):
        nonlocal next_block
        row = open_blocks.pop(label).row(next_block, label)
        next_block += 1
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

    for batch in batches:
        for owner, text, label in zip(ids(batch.column(0)).tolist(), batch.column(1), batch.column(2)):
            label = label.as_py()
            text = text.as_py() or ""
            block = open_blocks.setdefault(label, _Open())
            block.add(owner, split(text), len(text) + 16)
            if sum(b.size for b in open_blocks.values()) >= BLOCK_BYTES:
                yield closed(max(open_blocks, key=lambda x: open_blocks[x].size))
    for label in list(open_blocks):
        yield closed(label)


def shard_of(words: list[bytes], shards: int) -> np.ndarray:
    """Many checksums of short words share their low bits, so they are mixed."""
    mixed = np.fromiter(map(crc32, words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(33)).astype(np.int64) % shards


def by_shard(words: list[bytes], shards: int):
    """(shard, indices of its words) for each shard that has some."""
    shard = shard_of(words, shards)
    order = np.argsort(shard, kind="stable")
    found, starts = np.unique(shard[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, starts[1:]) if len(found) else [])


def ask(shards: int, blocks: pa.Table) -> pa.Table:
    """A row of ASKED for each block and shard."""
    rows = []
    for block, words, label in zip(*(blocks.column(c).to_pylist() for c in ("block", "words", "label"))):
        words = unpack_words(words)
        for shard, mine in by_shard(words, shards):
            rows.append((shard, block, label, pack_words([words[i] for i in mine.tolist()])))
    columns = list(zip(*rows)) if rows else [()] * 4
    types = [pa.int32(), pa.int64(), pa.string(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in ASKED.split(", ")])


def answers_in_order(words: list[bytes], shards: int, answers: dict[int, list]) -> list:
    """What the shards answered, put back to the order of the block's words."""
    out: list = [None] * len(words)
    for shard, mine in by_shard(words, shards):
        for i, value in zip(mine.tolist(), answers[shard]):
            out[i] = value
    return out
