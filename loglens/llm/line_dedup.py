"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

A line's key is the line with blanks stripped and A-Z lower-cased. A key of at least
``MIN_CHARS`` code points that two documents hold keeps its lines in the smallest
doc_id alone; all other lines stay.

``LineIndex`` holds two tables. *refs*: for each chunk of documents, its exact
(key, doc_id) pairs. *shards*: for each shard of keys, the exact reference counts
(key, chunk, number of documents, smallest doc_id) and a cuckoo filter with one
fingerprint per live key. Keys arrive in batches; a key that the filter has not seen is
new and needs no look-up, only possible repeats are settled in the exact counts. A key
in very many documents is one row per chunk in its shard, however many documents hold
it. Inserting documents adds references; deleting documents takes theirs back, deletes
the fingerprints of keys that nobody holds any more, and the next smallest doc_id keeps
the line, as if the deleted documents had never been there.

Results for odd input: a null or empty text is one empty line; a null doc_id comes
before every other; rows that share a doc_id are one document (each row gets its own
result); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loglens.llm.common import CHUNKS_PER_PARTITION, blob, chunk_count, counts_of, id_array, ids, result_type, spread, unblob, with_chunks
from loglens.session import store_table

MIN_CHARS = 10
BLANKS = b" \t\n\x0b\x0c\r"
KEY = np.dtype([("a", "<u8"), ("b", "<u8")])
BATCH = 1 << 16
SLOTS = 4
MAX_ROUNDS = 200

REFS = "chunk int, keys binary, docs binary"
SUMMARY = "shard int, chunk int, keys binary, counts binary, firsts binary"
SHARD = "shard int, filter binary, keys binary, chunks binary, counts binary, firsts binary"
VERDICT = "chunk int, keys binary, docs binary"


def key_of(line: bytes) -> bytes | None:
    """The digest of the line's key; None for a key that is too short to count."""
    key = line.strip(BLANKS).lower()
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, each in one of two buckets that name each
    other; batches are placed with array operations. Grows by being built anew."""

    def __init__(self, room: int = 1, table: np.ndarray | None = None):
        if table is None:
            bits = max(1, int(np.ceil(np.log2(max(1, room) / (0.8 * SLOTS)))))
            table = np.zeros((1 << bits, SLOTS), np.uint16)
        self.table = table

    @classmethod
    def of(cls, keys: np.ndarray, room: int = 0) -> CuckooFilter:
        """A filter of these keys, each given once."""
        room = max(room, len(keys), 1)
        while True:
            new = cls(room)
            if new.insert(keys):
                return new
            room *= 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray):
        mark = (keys["b"] >> np.uint64(48)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        return mark, (keys["a"] & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (spread(mark) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, bucket = self._places(keys)
        found = (self.table[bucket] == mark[:, None]).any(1)
        return found | (self.table[self._other(mark, bucket)] == mark[:, None]).any(1)

    def _fill(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; True where one had room."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        rank = np.arange(len(b)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(b)]])))
        empty = self.table[b] == 0
        fits = rank < empty.sum(1)
        slot = np.argmax(np.cumsum(empty, 1) == (rank + 1)[:, None], 1)
        self.table[b[fits], slot[fits]] = mark[order][fits]
        done = np.zeros(len(mark), bool)
        done[order[fits]] = True
        return done

    def insert(self, keys: np.ndarray) -> bool:
        """Add keys not held yet; False when the filter is too full (build it anew)."""
        mark, bucket = self._places(keys)
        left = ~self._fill(mark, bucket)
        mark, bucket = mark[left], self._other(mark[left], bucket[left])
        for turn in range(MAX_ROUNDS):
            left = ~self._fill(mark, bucket)
            mark, bucket = mark[left], bucket[left]
            if not len(mark):
                return True
            # One of each full bucket swaps places with the fingerprint of a slot.
            _, one = np.unique(bucket, return_index=True)
            slot = (spread(mark[one].astype(np.uint64) + np.uint64(turn)) % np.uint64(SLOTS)).astype(np.int64)
            out = self.table[bucket[one], slot].copy()
            self.table[bucket[one], slot] = mark[one]
            mark[one] = out
            bucket[one] = self._other(out, bucket[one])
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that are held."""
        mark, bucket = self._places(keys)
        for other in (False, True):
            at = self._other(mark, bucket) if other else bucket
            while len(mark):
                hit = self.table[at] == mark[:, None]
                can = np.flatnonzero(hit.any(1))
                _, one = np.unique(at[can], return_index=True)
                can = can[one]
                if not len(can):
                    break
                self.table[at[can], hit[can].argmax(1)] = 0
                stay = np.ones(len(mark), bool)
                stay[can] = False
                mark, bucket, at = mark[stay], bucket[stay], at[stay]


# --- what the tasks do ---


def _sorted_rows(docs: pa.Table):
    doc, texts = ids(docs["doc_id"]), docs["text"].to_pylist()
    for i in np.argsort(doc, kind="stable").tolist():
        yield i, int(doc[i]), (texts[i] or "").encode()


def _chunk_refs(key, docs: pa.Table) -> pa.Table:
    """The exact (key, doc_id) pairs of a chunk, in order of doc_id."""
    pairs: dict[tuple[bytes, int], None] = {}
    for _, doc, text in _sorted_rows(docs):
        for line in text.split(b"\n"):
            name = key_of(line)
            if name:
                pairs[name, doc] = None
    return pa.table(
        {
            "chunk": pa.array([key[0].as_py()], pa.int32()),
            "keys": pa.array([b"".join(k for k, _ in pairs)], pa.binary()),
            "docs": pa.array([blob(np.array([d for _, d in pairs], np.int64))], pa.binary()),
        }
    )


def _summaries(shards: int, batches):
    """For each chunk and shard: key, number of its documents in the chunk, the smallest."""
    for batch in batches:
        for row in batch.to_pylist():
            keys, docs = np.frombuffer(row["keys"], KEY), np.frombuffer(row["docs"], np.int64)
            shard = spread(keys["b"]) % np.uint64(shards)
            order = np.lexsort((docs, keys["a"], keys["b"], shard))
            keys, docs, shard = keys[order], docs[order], shard[order]
            begin = _begins(keys)
            counts = np.diff(np.concatenate([begin, [len(keys)]])).astype(np.uint32)
            keys, firsts, shard = keys[begin], docs[begin], shard[begin]
            at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
            parts = list(zip(at, np.concatenate([at[1:], [len(shard)]]))) if len(at) else []
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([int(shard[a]) for a, _ in parts], pa.int32()),
                    "chunk": pa.array([row["chunk"]] * len(parts), pa.int32()),
                    "keys": pa.array([blob(keys[a:b]) for a, b in parts], pa.binary()),
                    "counts": pa.array([blob(counts[a:b]) for a, b in parts], pa.binary()),
                    "firsts": pa.array([blob(firsts[a:b]) for a, b in parts], pa.binary()),
                }
            )


def _begins(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _unpack(table: pa.Table):
    keys, counts = unblob(table["keys"], KEY), unblob(table["counts"], np.uint32)
    chunks = np.repeat(np.array(table["chunk"].to_pylist(), np.int32), counts_of(table["counts"], 4))
    return keys, chunks, counts, unblob(table["firsts"], np.int64)


def _update_shard(sign: int, key, state: pa.Table, changes: pa.Table) -> pa.Table:
    """Add (sign 1) the references of new chunks, or put (sign 0) recounted ones in the
    place of old ones; a count of 0 takes the reference away."""
    keys, chunks, counts, firsts = _unpack(changes)
    old = state.num_rows > 0
    if old:
        s_keys, s_chunks = unblob(state["keys"], KEY), unblob(state["chunks"], np.int32)
        s_counts, s_firsts = unblob(state["counts"], np.uint32), unblob(state["firsts"], np.int64)
        index = CuckooFilter.load(state["filter"][0].as_py())
    else:
        s_keys, s_chunks, s_counts, s_firsts = np.zeros(0, KEY), np.zeros(0, np.int32), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        index = CuckooFilter(len(keys))
    live = np.unique(s_keys)
    if sign:
        fresh = []
        for lo in range(0, len(keys), BATCH):
            some = np.unique(keys[lo : lo + BATCH])
            maybe = index.contains(some)
            new = some[~maybe]
            # What the filter may have seen is looked up in the exact keys.
            doubt = some[maybe]
            doubt = doubt[~np.isin(doubt, live)]
            for part in fresh:
                doubt = doubt[~np.isin(doubt, part)]
            new = np.concatenate([new, doubt])
            fresh.append(new)
            if len(new) and not index.insert(new):
                index = CuckooFilter.of(np.concatenate([live, *fresh]), 2 * (len(live) + len(keys)))
    keys = np.concatenate([s_keys, keys])
    chunks, counts, firsts = (np.concatenate(x) for x in ((s_chunks, chunks), (s_counts, counts), (s_firsts, firsts)))
    order = np.lexsort((np.arange(len(keys)), chunks, keys["a"], keys["b"]))
    keys, chunks, counts, firsts = keys[order], chunks[order], counts[order], firsts[order]
    if len(keys):  # the later of two rows for a key and chunk counts
        last = np.concatenate([(keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1]), [True]])
        last &= counts > 0
        keys, chunks, counts, firsts = keys[last], chunks[last], counts[last], firsts[last]
    if not sign:
        index.delete(live[~np.isin(live, keys)])
    return pa.table(
        {
            "shard": pa.array([key[0].as_py()], pa.int32()),
            "filter": pa.array([index.dump()], pa.binary()),
            **{n: pa.array([blob(v)], pa.binary()) for n, v in (("keys", keys), ("chunks", chunks), ("counts", counts), ("firsts", firsts))},
        }
    )


def _settle(keys, chunks, counts, firsts) -> pa.Table:
    """Tells each chunk the keys of its own that two documents hold, and who keeps them."""
    order = np.lexsort((keys["a"], keys["b"]))
    keys, chunks, counts, firsts = keys[order], chunks[order], counts[order], firsts[order]
    begin = _begins(keys)
    size = np.diff(np.concatenate([begin, [len(keys)]]))
    total = np.add.reduceat(counts.astype(np.int64), begin) if len(begin) else begin
    keeper = np.minimum.reduceat(firsts, begin) if len(begin) else begin
    shared = np.repeat(total > 1, size)
    keys, chunks, keeper = keys[shared], chunks[shared], np.repeat(keeper, size)[shared]
    order = np.argsort(chunks, kind="stable")
    keys, chunks, keeper = keys[order], chunks[order], keeper[order]
    at = np.flatnonzero(np.concatenate([[True], chunks[1:] != chunks[:-1]])) if len(chunks) else np.zeros(0, np.int64)
    ends = np.concatenate([at[1:], [len(chunks)]]) if len(at) else at
    return pa.table(
        {
            "chunk": pa.array([int(chunks[a]) for a in at], pa.int32()),
            "keys": pa.array([blob(keys[a:b]) for a, b in zip(at, ends)], pa.binary()),
            "docs": pa.array([blob(keeper[a:b]) for a, b in zip(at, ends)], pa.binary()),
        }
    )


def _verdicts(batches):
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for i in range(table.num_rows):
            row = table.slice(i, 1)
            parts = (unblob(row[n], t) for n, t in (("keys", KEY), ("chunks", np.int32), ("counts", np.uint32), ("firsts", np.int64)))
            yield from _settle(*parts).to_batches()


def _recount(shards: int, key, refs: pa.Table, gone: pa.Table) -> pa.Table:
    """New summaries of the keys that a chunk's deleted documents held."""
    empty = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("firsts", pa.binary())])
    if not refs.num_rows or not gone.num_rows:
        return empty.empty_table()
    keys, docs = unblob(refs["keys"], KEY), unblob(refs["docs"], np.int64)
    out = np.isin(docs, ids(gone["doc_id"]))
    touched = np.unique(keys[out])
    rest = ~out & np.isin(keys, touched)
    row = {"chunk": key[0].as_py(), "keys": blob(keys[rest]), "docs": blob(docs[rest])}
    left = pa.Table.from_batches(_summaries(shards, [pa.RecordBatch.from_pylist([row])]))
    lost = touched[~np.isin(touched, keys[rest])]
    row = {"chunk": key[0].as_py(), "keys": blob(lost), "docs": blob(np.zeros(len(lost), np.int64))}
    zero = pa.Table.from_batches(_summaries(shards, [pa.RecordBatch.from_pylist([row])]))
    nought = pa.array([bytes(len(x)) for x in zero["counts"].to_pylist()], pa.binary())
    zero = zero.set_column(3, "counts", nought)
    return pa.concat_tables([left.cast(empty), zero.cast(empty)])


def _refs_left(key, refs: pa.Table, gone: pa.Table) -> pa.Table:
    if not refs.num_rows:
        return refs.select(["chunk", "keys", "docs"])
    keys, docs = unblob(refs["keys"], KEY), unblob(refs["docs"], np.int64)
    keep = ~np.isin(docs, ids(gone["doc_id"])) if gone.num_rows else np.ones(len(docs), bool)
    return pa.table(
        {
            "chunk": pa.array([key[0].as_py()], pa.int32()),
            "keys": pa.array([blob(keys[keep])], pa.binary()),
            "docs": pa.array([blob(docs[keep])], pa.binary()),
        }
    )


def _drop_lines(texts: bool, docs: pa.Table, verdicts: pa.Table) -> pa.Table:
    """The lines that stay, for each row of a chunk."""
    names = unblob(verdicts["keys"], KEY).tobytes()
    keeper = dict(zip((names[i : i + 16] for i in range(0, len(names), 16)), unblob(verdicts["docs"], np.int64).tolist()))
    rows, order = [], []
    for i, doc, text in _sorted_rows(docs):
        order.append(i)
        lines = text.split(b"\n")
        kept = [x for x in lines if keeper.get(key_of(x), doc) == doc] if keeper else lines
        left = b"\n".join(kept)
        rows.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256(left).hexdigest()) + ((left.decode(),) if texts else ()))
    columns = {
        "doc_id": id_array(np.array([r[0] for r in rows], np.int64)),
        "n_lines": pa.array([r[1] for r in rows], pa.int64()),
        "n_dropped": pa.array([r[2] for r in rows], pa.int64()),
        "kept_sha256": pa.array([r[3] for r in rows], pa.string()),
    }
    if texts:
        columns["kept_text"] = pa.array([r[4] for r in rows], pa.string())
        columns["row"] = docs["row"].take(pa.array(order, pa.int64()))
    return pa.table(columns)


# --- the index ---


@dataclass(frozen=True)
class LineIndex:
    """References and counts of the lines of a growing and shrinking set of documents.

    ``insert`` takes documents whose ids are not held yet; ``delete`` takes a table of
    doc_ids. Both give a new index, written to the shared folder; the old one stays.
    """

    refs: DataFrame
    shards: DataFrame
    chunks: int
    n_shards: int
    generations: int = 0

    @classmethod
    def empty(cls, spark: SparkSession, chunks: int | None = None) -> LineIndex:
        n = chunks or chunk_count(spark)
        # A chunk sends a row to each shard, so there are no more shards than partitions.
        return cls(spark.createDataFrame([], REFS), spark.createDataFrame([], SHARD), n, max(1, n // CHUNKS_PER_PARTITION))

    def _updated(self, changes: DataFrame, sign: int) -> DataFrame:
        def update(key, state, rows):
            return _update_shard(sign, key, state, rows)

        return self.shards.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(update, SHARD)

    def insert(self, docs: DataFrame, store: bool = True) -> LineIndex:
        """Each inserted batch has chunks of its own, so references never change places."""
        shift = self.generations * self.chunks

        def refs_of(key, table):
            return _chunk_refs([pa.scalar(key[0].as_py() + shift)], table)

        refs = with_chunks(docs, self.chunks).groupBy("chunk").applyInArrow(refs_of, REFS)
        refs = store_table(refs, "line-refs") if store else refs
        changes = refs.mapInArrow(partial(_summaries, self.n_shards), SUMMARY)
        shards = self._updated(changes, 1)
        shards = store_table(shards, "line-shards") if store else shards
        return LineIndex(self.refs.unionByName(refs), shards, self.chunks, self.n_shards, self.generations + 1)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index as if the documents had never been inserted."""
        gone = doc_ids.select("doc_id").distinct()
        base = with_chunks(gone.selectExpr("doc_id", "string(null) AS text"), self.chunks)
        by = None
        for g in range(self.generations):
            part = base.selectExpr(f"chunk + {g * self.chunks} AS chunk", "doc_id")
            by = part if by is None else by.unionByName(part)
        if by is None:
            return self

        n_shards = self.n_shards

        def recount(key, refs, doc_ids):
            return _recount(n_shards, key, refs, doc_ids)

        both = self.refs.groupBy("chunk").cogroup(by.groupBy("chunk"))
        changes = both.applyInArrow(recount, SUMMARY)
        refs = store_table(both.applyInArrow(_refs_left, REFS), "line-refs")
        shards = store_table(self._updated(changes, 0), "line-shards")
        return LineIndex(refs, shards, self.chunks, self.n_shards, self.generations)

    def verdicts(self) -> DataFrame:
        """For each chunk of documents: its shared keys and the doc_id that keeps each."""
        return self.shards.mapInArrow(_verdicts, VERDICT)

    def dedup(self, docs: DataFrame, texts: bool = False) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_sha256 of each row; with ``texts`` also kept_text and
        the other columns of the row."""
        dealt = with_chunks(docs, self.chunks, texts)
        verdicts = self.verdicts().selectExpr(f"chunk % {self.chunks} AS chunk", "keys", "docs")
        schema = result_type(docs, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", texts)

        def drop(rows, notes):
            return _drop_lines(texts, rows, notes)

        return dealt.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(drop, schema)


def line_dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Line dedup of one table: its documents go into an empty index, and their lines are
    judged by it. Nothing is stored; keep a ``LineIndex`` to add or delete documents later."""
    index = LineIndex.empty(docs.sparkSession).insert(docs, store=False)
    return index.dedup(docs, texts)
