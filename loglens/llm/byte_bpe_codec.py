"""Byte-level BPE over the distinct words of the corpus, and back to bytes.

Every text is split by the tokenizer's pattern. Blocks of documents keep, for each place,
the number of its word; only distinct words travel. A shard gets each word of all blocks
that hash to it, encodes every distinct one once by merging the neighbouring pair of lowest
rank again and again, and answers with ids; a block joins them back and puts each text
together by position. Decoding joins ids with the table of token bytes, word by word, and
puts the bytes together by position, too. The documents' text is read once and not shuffled.

The rank file's path and the pattern are parameters; tasks read the file themselves. Its
tokens must hold every single byte.

Results for odd input: a null text is empty; an empty text has no ids (the digests are those
of nothing); repeated rows give equal rows; a null doc_id is kept; an empty table gives an
empty table; other columns are ignored. A text, whatever its length, lies in one block.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import id_array
from loglens.llm.word_blocks import ASKED, FOLDED, answers_in_order, ask, fold, planes, shards_for, unplanes, unpack_codes, unpack_words

ANSWERED = "block long, shard int, ids binary, words int"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SHORT = 64  # bytes of a word up to which all pairs are looked at for each merge


class Ranks:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes_of = {i: token for token, i in self.rank.items()}
        self.width = np.dtype("<u2" if max(self.bytes_of) < 1 << 16 else "<u4")

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word; merges go by rank, equal ranks from the left."""
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        return self._short(word) if len(word) <= SHORT else self._long(word)

    def _short(self, word: bytes) -> list[int]:
        rank = self.rank.get
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [rank(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            known = [r for r in pairs if r is not None]
            if not known:
                return [self.rank[p] for p in parts]
            i = pairs.index(min(known))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i])
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1])

    def _long(self, word: bytes) -> list[int]:
        """The same with a heap of pairs and links to neighbours, for words of any length."""
        rank = self.rank.get
        n = len(word)
        end = list(range(1, n + 1))  # where the part that begins here ends; 0 once merged away
        before = list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or rank(word[i : end[mid]]) != r:
                continue  # one of its parts has changed since
            after = end[i] = end[mid]
            end[mid] = 0
            if after < n:
                before[after] = i
                if (r := rank(word[i : end[after]])) is not None:
                    heapq.heappush(heap, (r, i))
            if i and (r := rank(word[before[i] : after])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [self.rank[word[i : end[i]]] for i in range(n) if end[i]]

    def decode(self, word_ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, word_ids))


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def _fold(pattern: str, batches):
    return fold(batches, regex.compile(pattern).findall)


def _encode(path: str, asked: pa.Table) -> pa.Table:
    """A shard: every distinct word of all blocks once, then an answer for each block."""
    table = ranks(path)
    known: dict[bytes, list[int]] = {}
    rows = []
    for block, shard, words in zip(*(asked.column(c).to_pylist() for c in ("block", "shard", "words"))):
        words = unpack_words(words)
        for w in words:
            if w not in known:
                known[w] = table.encode(w)
        found = [known[w] for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for f in found for i in f), table.width, int(counts.sum()))
        rows.append((block, shard, zstandard.compress(planes(counts.astype("<u4")) + planes(flat), 1), len(words)))
    columns = list(zip(*rows)) if rows else [()] * 4
    types = [pa.int64(), pa.int32(), pa.binary(), pa.int32()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in ANSWERED.split(", ")])


def _reassemble(path: str, shards: int, with_ids: bool, blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """All texts of a block from the ids of its words, and from the bytes of these ids."""
    table = ranks(path)
    out: list[tuple] = []
    told = {}
    for shard, data, n in zip(*(answers.column(c).to_pylist() for c in ("shard", "ids", "words"))):
        raw = zstandard.decompress(data)
        flat = unplanes(raw[4 * n :], table.width).tolist()
        ends = np.cumsum(unplanes(raw[: 4 * n], "<u4").astype(np.int64)).tolist()
        told[shard] = [flat[a:b] for a, b in zip([0, *ends], ends)]
    for row in blocks.to_pylist():
        words = answers_in_order(unpack_words(row["words"]), shards, told)
        shown = [",".join(map(str, w)) for w in words]
        decoded = list(map(table.decode, words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = unpack_codes(row["codes"])
        at = 0
        for owner, n in zip(np.frombuffer(row["owner"], np.int64).tolist(), np.frombuffer(row["places"], np.int64).tolist()):
            mine = codes[at : at + n]
            at += n
            places = mine.tolist()
            digest = hashlib.sha256(",".join(map(shown.__getitem__, places)).encode()).hexdigest()
            back = b"".join(map(decoded.__getitem__, places))
            text_ids = [i for p in places for i in words[p]] if with_ids else None
            out.append((owner, int(sizes[mine].sum()), digest, hashlib.sha256(back).hexdigest(), text_ids, back if with_ids else None))
    columns = list(zip(*out)) if out else [()] * 6
    arrays = [id_array(np.array(columns[0], np.int64)), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if with_ids:
        arrays += [pa.array(columns[4], pa.list_(pa.int32())), pa.array(columns[5], pa.binary())]
        names += ["ids", "decoded"]
    return pa.table(arrays, names)


def encode_decode(docs: DataFrame, rank_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; ``with_ids`` adds the ids and
    the bytes they decode to."""
    shards = shards_for(docs)
    schema = RESULT + (", ids array<int>, decoded binary" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(None).cast("string"))
    blocks = rows.mapInArrow(partial(_fold, pattern), FOLDED).groupBy("block")

    def asking(table):
        return ask(shards, table)

    def encoding(table):
        return _encode(rank_path, table)

    def reassembling(table, answers):
        return _reassemble(rank_path, shards, with_ids, table, answers)

    answers = blocks.applyInArrow(asking, ASKED).groupBy("shard").applyInArrow(encoding, ANSWERED)
    return blocks.cogroup(answers.groupBy("block")).applyInArrow(reassembling, schema)
