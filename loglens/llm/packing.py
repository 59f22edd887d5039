"""Packing token sequences by minimum bin slack.

Each document becomes ids and an end id. Every full window of ``WINDOW`` ids of a long
document is a sequence of its own; what remains of each document, shorter than a window,
goes into a pool. For each new sequence the longest remainder is laid down, and the
multiset of other remainders that fills the rest closest is found by subset sums: a
bitset holds the reachable sums after each length (each with as many copies as the pool
has), and the counts are read back from the last bitset to the first. A sequence that
comes out full is written; otherwise the pool waits for more documents. At the end of
the input (or when the pool is full and no sum fits) a remainder is cut to close the
gap, and what is left last is cut into sequences of powers of two, so there is no padding.

Packing runs inside each input partition, in blocks, without a shuffle; memory holds the
pool and one block. The same partition gives the same sequences again after a lost
executor. sequence_id is the partition number and a counter.

Ids come from a tokenizer file. Where its merges are in the order of its ids, as in byte-level
files, the rank encoder gives the same ids with less work; no memory of words is kept.

Results for odd input: null text is empty and has the end id alone; repeated rows are
packed each; a null doc_id is kept as null; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
END_ID = 0
POOL_IDS = 1 << 21  # remainders waiting; beyond it gaps are closed by cutting
WAIT_IDS = 1 << 17  # with fewer, the pool waits for more documents
#: How byte-level tokenizer files split text (fixed values of that file format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = np.uint32(END_ID)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The file's tokens as bytes with their ids, where ids follow the order of the merges and
    nothing but the byte-level split and the merges acts on a text; else None."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = not spec["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or not plain or any(model.get(x) for x in odd):
        return None
    # Bytes that are printable characters stand for themselves, the others for those from U+0100 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)).difference(shown)))}
    vocab = model["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        return None
    added = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in added}


class Ids:
    """Ids of whole texts, as the tokenizer file has them.

    Merges in the order of ids are what the rank encoder does; it needs no memory of words.
    Files of another kind go through the library that reads them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else lambda x: [x]
        ranks = byte_ranks(path)
        if ranks:
            import tiktoken

            self.encode = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def of(self, text: str) -> np.ndarray:
        """As the library encodes, strings of special tokens included."""
        if any(s in text for s in self.special):
            pieces = [[self.special[x]] if x in self.special else self.encode(x) for x in self.cut(text)]
            return np.array([i for p in pieces for i in p], np.uint32)
        return np.array(self.encode(text), np.uint32)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Ids:
    return Ids(path)


def closest_fill(room: int, counts: dict[int, int]) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``room`` of the given lengths, each used at most as often as
    counted, and how many of each length make it."""
    full = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int]] = []  # (length, reachable sums before it)
    for length in sorted((x for x in counts if x <= room), reverse=True):
        steps.append((length, reach))
        left, take = counts[length], 1
        while left:  # copies in doubling groups
            take = min(take, left)
            shifted = length * take
            if shifted > room:
                # Larger groups do not fit; single copies up to the room remain.
                for _ in range(min(left, room // length)):
                    reach |= (reach << length) & full
                break
            reach |= (reach << shifted) & full
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    used: dict[int, int] = {}
    at = best
    for length, before in reversed(steps):
        n = 0
        while not (before >> at & 1):  # some copies of this length are in the sum
            at -= length
            n += 1
        if n:
            used[length] = n
    return best, used


class Packer:
    """Sequences out of a stream of documents; ``rows`` collects (piece of a document,
    its sequence and offset)."""

    def __init__(self, first_sequence: int, window: int = WINDOW, wait: int = WAIT_IDS, most: int = POOL_IDS):
        self.window, self.wait, self.most = window, wait, most
        self.next = first_sequence
        self.pool: dict[int, list] = {}  # length -> remainders of that length
        self.counts: dict[int, int] = {}
        self.ids = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self._write([(doc_id, at, ids[at : at + self.window], total)])
            at += self.window
        if total > at:
            self._put((doc_id, at, ids[at:], total))
        if self.ids >= self.wait:
            self._fill(False)

    def finish(self) -> None:
        self._fill(True)

    def _put(self, piece) -> None:
        n = len(piece[2])
        self.pool.setdefault(n, []).append(piece)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.ids += n

    def _take(self, length: int):
        pieces = self.pool[length]
        piece = pieces.pop()
        if pieces:
            self.counts[length] -= 1
        else:
            del self.pool[length], self.counts[length]
        self.ids -= length
        return piece

    def _write(self, pieces) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
            self.rows.append((doc_id, start, len(ids), crc, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def _fill(self, last: bool) -> None:
        """Write full sequences until the pool should wait (or, at the end, is empty)."""
        while self.counts and (last or self.ids > self.wait // 2):
            seed = self._take(max(self.counts))
            room = self.window - len(seed[2])
            best, used = closest_fill(room, self.counts) if room else (0, {})
            if best < room and not last and self.ids < self.most:
                self._put(seed)
                self.wait = min(self.most, 2 * self.wait)  # ask again with more to choose from
                return
            pieces = [seed] + [self._take(n) for n, k in used.items() for _ in range(k)]
            if best < room and self.counts:  # close the gap with part of a remainder
                doc_id, start, ids, total = self._take(max(self.counts))
                gap = room - best
                pieces.append((doc_id, start, ids[:gap], total))
                if len(ids) > gap:
                    self._put((doc_id, start + gap, ids[gap:], total))
                best = room
            if best == room:
                self._write(pieces)
            else:
                self._powers(pieces)

    def _powers(self, pieces) -> None:
        """The last ids: sequences whose lengths are powers of two, nothing padded."""
        size = sum(len(p[2]) for p in pieces)
        pieces = pieces[::-1]
        while size:
            room = 1 << (size.bit_length() - 1)
            size -= room
            part = []
            while room:
                doc_id, start, ids, total = pieces.pop()
                part.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    pieces.append((doc_id, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self._write(part)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _pack(path: str, batches):
    encode = tokenizer(path)
    partition = TaskContext.get().partitionId() if TaskContext.get() else 0
    packer = Packer(partition << 40)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            packer.add(doc_id, np.append(encode.of(text or ""), END))
            if len(packer.rows) >= 1 << 15:
                yield _rows(packer.rows)
                packer.rows = []
    packer.finish()
    yield _rows(packer.rows)


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row for each piece of a document, with its sequence and place in it."""

    def run(batches):
        return _pack(tokenizer_path, batches)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
