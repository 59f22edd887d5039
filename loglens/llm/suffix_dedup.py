"""Exact substring dedup over all documents by deep-shallow suffix sorting.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier:
in a smaller doc_id, or earlier in the same document. Strings are judged on the
input, and never cross documents.

How the sort is spread. A suffix array over the whole corpus would be one sorted
list; only the order among suffixes that may agree for ``LENGTH`` bytes matters.
Each such window is sent where its *anchor* says: the least hash of its ``GRAM``-byte
grams. Equal windows have equal anchors, and neighbouring windows mostly share one,
so they travel as one segment of text. Anchors that occur once in the corpus are
never sent: their hashes are counted first (8 bytes for about 27 bytes of text).
In each slot the suffixes are put in order by multikey quicksort on 8-byte words to
a shallow depth, and the groups that still agree by blind tries, which branch on the
first byte that differs from a reference suffix. Runs of equal suffixes remain; all
but the earliest lose.

Hot content: documents that repeat an earlier text whole are set aside first (ranked in
salted rounds); a chunk sends each of its distinct segments once; the windows of an
anchor that many chunks hold are dealt by their own content, so no slot gets a group
that grows with the number of copies.

Results for odd input: null text is empty; texts under ``LENGTH`` bytes keep all; a null
doc_id comes before every other; rows that repeat both doc_id and text are one document
and get equal results; rows that share a doc_id only are documents of their own, ordered
by text; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import (
    NO_ID, blob, chunk_count, chunk_of, counts_of, freeing, id_array, ids, not_first, packed, part_count, ranges, result_type, spread, unblob, with_chunks,
)

LENGTH = 100
GRAM = 48
SHALLOW_WORDS = 3  # depth of the multikey quicksort, in words of 8 bytes
HOT_ANCHOR = 512  # an anchor with more distinct holders is dealt by window
SALTS = 64
BLOCK = 1 << 19
TRIE_ROWS = 1 << 18
ORDINAL = np.int64(1) << np.int64(40)  # start + ordinal of the text among those of its doc_id

NOTES = "chunk int, kind int, docs binary, data binary, more binary"
SEGMENTS = "slot int, kind int, chunk int, anchors binary, docs binary, starts binary, lengths binary, texts binary"
COPY, REPLY, SPAN, SEGMENT = 0, 1, 2, 3


# --- deep-shallow sorting of byte strings in one buffer ---


def _words(data: np.ndarray) -> np.ndarray:
    """The big-endian 8-byte word that begins at each byte; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8", padded, 0, (1,)).astype(np.uint64)


def _groups(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each run of equal labels."""
    if not len(label):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    return starts, np.diff(np.concatenate([starts, [len(label)]]))


def _multikey(data, start, label, depth):
    """Three-way partition of every group by its pivot's word, all groups at once, until
    each group agrees on its first ``depth`` words. Returns the order and new labels."""
    words = _words(data)
    order = np.arange(len(start))
    at = np.zeros(len(start), np.int64)  # words that the element's group agrees on
    open_ = np.ones(len(start), bool)
    while True:
        live = np.flatnonzero(open_)
        if not len(live):
            return order, label
        lab = label[live]
        first, size = _groups(lab)
        single = np.repeat((size == 1), size)
        if single.any():
            open_[live[single]] = False
            live, lab = live[~single], lab[~single]
            if not len(live):
                return order, label
            first, size = _groups(lab)
        where = start[order[live]] + 8 * at[live]
        word = np.where(where < len(data), words[np.minimum(where, len(data) - 1)], np.uint64(0))
        pivot = np.repeat(word[first + size // 2], size)
        side = (word > pivot).astype(np.int64) - (word < pivot)
        group = np.repeat(np.arange(len(first)), size)
        key = group * 3 + side + 1
        move = np.argsort(key, kind="stable")
        key, side = key[move], side[move]
        order[live] = order[live[move]]
        at[live] = at[live[move]] + (side == 0)
        # Labels stay increasing along the order: a part is named by where it begins.
        begin, count = _groups(key)
        label[live] = np.repeat(live[begin], count)
        open_[live] = at[live] < depth


def _blind_tries(data, start, order, label, length):
    """Order the groups that agree so far: all members are compared with the group's first,
    and branch by (depth of the first differing byte, that byte); branches follow in turn."""
    open_ = np.ones(len(order), bool)
    while True:
        live = np.flatnonzero(open_)
        first, size = _groups(label[live])
        many = np.repeat(size > 1, size)
        open_[live[~many]] = False
        live = live[many]
        if not len(live):
            return order, label
        first, size = _groups(label[live])
        ends = np.cumsum(size)
        lo = 0
        while lo < len(first):  # so many groups at a time as fit the working memory
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TRIE_ROWS, "right")))
            a, b = int(first[lo]), int(ends[hi - 1])
            _branch(data, start, order, label, open_, live[a:b], size[lo:hi], length)
            lo = hi


def _branch(data, start, order, label, open_, live, size, length):
    first = np.cumsum(size) - size
    mine = start[order[live]]
    reference = np.repeat(mine[first], size)
    depth = np.full(len(live), length, np.int64)
    side = np.zeros(len(live), np.int64)
    byte = np.zeros(len(live), np.int64)
    for lo in range(0, len(live), 1 << 15):
        m, r = mine[lo : lo + (1 << 15)], reference[lo : lo + (1 << 15)]
        span = np.arange(length)
        x, y = data[m[:, None] + span], data[r[:, None] + span]
        differs = x != y
        d = differs.argmax(1)
        odd = np.flatnonzero(differs[np.arange(len(d)), d])
        depth[lo + odd] = d[odd]
        byte[lo + odd] = x[odd, d[odd]]
        side[lo + odd] = np.where(x[odd, d[odd]] > y[odd, d[odd]], 1, -1)
    group = np.repeat(np.arange(len(size)), size)
    move = np.lexsort((byte, np.where(side > 0, -depth, depth), side, group))
    order[live] = order[live[move]]
    group, depth, side, byte = group[move], depth[move], side[move], byte[move]
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (depth[1:] != depth[:-1]) | (side[1:] != side[:-1]) | (byte[1:] != byte[:-1])])
    begin = np.flatnonzero(new)
    label[live] = np.repeat(live[begin], np.diff(np.concatenate([begin, [len(live)]])))
    open_[live] = depth < length


def deep_shallow(data: np.ndarray, start: np.ndarray, length: int, group: np.ndarray | None = None):
    """Sort the strings of ``length`` bytes at ``start``, in each group of their own.

    Returns (order, label): the sorted order of the strings, and along it a label that
    equal strings share.
    """
    group = np.zeros(len(start), np.int64) if group is None else group
    base = np.argsort(group, kind="stable")
    begin, size = _groups(group[base])
    label = np.repeat(begin, size)
    order, label = _multikey(data, start[base], label, min(SHALLOW_WORDS, length // 8))
    order, label = _blind_tries(data, start[base], order, label, length)
    return base[order], label


# --- anchors and segments ---


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place where they fit."""
    n = len(data) - GRAM + 1
    mixed = spread(np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)).astype(np.uint64))
    total = np.zeros(n, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for j in range(0, GRAM, 8):
        total *= factor
        total += mixed[j : j + n]
    return spread(total)


def segments(data: np.ndarray, offsets: np.ndarray):
    """Runs of windows with one anchor: (document, first window, windows, anchor hash).
    Windows are places in ``data``; the anchor of a window depends on its bytes alone."""
    found = []
    width = LENGTH - GRAM + 1
    documents = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    low = np.uint64((1 << 20) - 1)
    for b in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        part = np.ascontiguousarray(data[b : b + BLOCK + LENGTH - 1])
        hashes = _gram_hashes(part)
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        step = 1
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        n = len(least)
        anchor = (least & low).astype(np.int64)
        doc = documents[b : b + n]
        fits = doc == documents[b + LENGTH - 1 : b + LENGTH - 1 + n]
        change = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (fits[1:] != fits[:-1])])
        begin = np.flatnonzero(change)
        count = np.diff(np.concatenate([begin, [n]]))
        keep = fits[begin]
        begin, count = begin[keep], count[keep]
        found.append((doc[begin].astype(np.int64), begin + b, count, hashes[anchor[begin]]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


# --- what the tasks do ---


class _Chunk:
    """The distinct documents of a chunk, in order of (doc_id, text), with those set aside
    that repeat a text of a smaller doc_id."""

    def __init__(self, docs: pa.Table, notes: pa.Table):
        table = docs.select(["doc_id", "text"])
        table = table.set_column(1, "text", pc.fill_null(table["text"].cast(pa.large_string()), ""))
        self.table = table.group_by(["doc_id", "text"], use_threads=False).aggregate([([], "count_all")])
        doc = ids(self.table["doc_id"])
        texts = self.table["text"].to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (doc[i], texts[i].encode()))
        self.table = self.table.take(pa.array(order, pa.int64()))
        self.doc = doc[order] if order else doc
        self.repeats = self.table["count_all"].to_pylist()
        self.data, self.offsets = packed(self.table["text"])
        n = len(self.doc)
        place = np.arange(n) - np.searchsorted(self.doc, self.doc, "left")
        self.key = place * ORDINAL  # added to a start
        kinds = np.array(notes["kind"].to_pylist(), np.int64)
        self.notes = {k: notes.filter(pa.array(kinds == k)) for k in (COPY, REPLY, SPAN)}
        self.copy = np.zeros(n, bool)
        copies = self.notes[COPY]
        if copies.num_rows:
            lost = {}
            for d, h in zip(unblob(copies["docs"], np.int64).tolist(), [h for b in copies["data"].to_pylist() for h in (b[i : i + 32] for i in range(0, len(b), 32))]):
                lost.setdefault(d, set()).add(h)
            for i in np.flatnonzero(np.isin(self.doc, np.array(list(lost), np.int64))):
                self.copy[i] = hashlib.sha256(self.text(i)).digest() in lost[int(self.doc[i])]

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def segments(self):
        if self.copy.any():
            keep = np.flatnonzero(~self.copy)
            sizes = np.diff(self.offsets)[keep]
            data = self.data[ranges(self.offsets[keep], sizes)]
            offsets = np.concatenate([[0], np.cumsum(sizes)])
        else:
            keep, data, offsets = np.arange(len(self.doc)), self.data, self.offsets
        doc, first, count, anchor = segments(data, offsets)
        return data, keep[doc], first, first - offsets[doc], count, anchor


def _count_anchors(slots: int, key, docs: pa.Table, notes: pa.Table) -> pa.Table:
    chunk = _Chunk(docs, notes)
    *_, anchor = chunk.segments()
    values, counts = np.unique(anchor, return_counts=True)
    slot = (values >> np.uint64(32)) % np.uint64(slots)
    order = np.argsort(slot, kind="stable")
    begin, size = _groups(slot[order])
    rows = [(int(slot[order[b]]), order[b : b + n]) for b, n in zip(begin, size)]
    return pa.table(
        {
            "slot": pa.array([s for s, _ in rows], pa.int32()),
            "chunk": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "anchors": pa.array([blob(values[i]) for _, i in rows], pa.binary()),
            "counts": pa.array([blob(np.minimum(counts[i], 255).astype(np.uint8)) for _, i in rows], pa.binary()),
        }
    )


def _repeated_anchors(table: pa.Table) -> pa.Table:
    """Tells each chunk which of its anchors occur again, and which of them are hot."""
    anchors, counts = unblob(table["anchors"], np.uint64), unblob(table["counts"], np.uint8)
    chunks = np.repeat(np.array(table["chunk"].to_pylist(), np.int64), counts_of(table["counts"], 1))
    order = np.argsort(anchors, kind="stable")
    begin, size = _groups(anchors[order])
    total = np.add.reduceat(counts[order].astype(np.int64), begin) if len(begin) else begin
    kept = np.repeat(total > 1, size)
    hot = np.repeat(total > HOT_ANCHOR, size)[kept].astype(np.uint8)
    rows = order[kept]
    by = np.argsort(chunks[rows], kind="stable")
    begin, size = _groups(chunks[rows][by])
    parts = [by[b : b + n] for b, n in zip(begin, size)]
    return pa.table(
        {
            "chunk": pa.array([int(chunks[rows[p[0]]]) for p in parts], pa.int32()),
            "kind": pa.array([REPLY] * len(parts), pa.int32()),
            "docs": pa.nulls(len(parts), pa.binary()),
            "data": pa.array([blob(anchors[rows[p]]) for p in parts], pa.binary()),
            "more": pa.array([blob(hot[p]) for p in parts], pa.binary()),
        }
    )


class _Out:
    """Rows of SEGMENTS: one for each slot, with the segments packed."""

    def __init__(self, chunk: int):
        self.chunk, self.rows, self.spans = chunk, {}, []

    def add(self, slot: int, anchor: int, doc: int, start: int, text: bytes) -> None:
        self.rows.setdefault(slot, []).append((anchor, doc, start, text))

    def table(self, slots: int) -> pa.Table:
        rows = [
            (
                slot, SEGMENT, self.chunk, blob(np.array([x[0] for x in part], np.uint64)), blob(np.array([x[1] for x in part], np.int64)),
                blob(np.array([x[2] for x in part], np.int64)), blob(np.array([len(x[3]) for x in part], np.int32)), b"".join(x[3] for x in part),
            )
            for slot, part in self.rows.items()
        ]
        if self.spans:
            s = np.array(self.spans, np.int64)
            rows.append((self.chunk % slots, SPAN, self.chunk, None, blob(s[:, 0]), blob(s[:, 1]), blob(s[:, 2].astype(np.int32)), None))
        names = ["slot", "kind", "chunk", "anchors", "docs", "starts", "lengths", "texts"]
        types = [pa.int32()] * 3 + [pa.binary()] * 5
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types))})


def _send_segments(slots: int, key, docs: pa.Table, notes: pa.Table) -> pa.Table:
    out = _Out(key[0].as_py())
    if docs.num_rows:
        chunk = _Chunk(docs, notes)
        data, doc, place, start, count, anchor = chunk.segments()
        reply = chunk.notes[REPLY]
        known, hot = unblob(reply["data"], np.uint64), unblob(reply["more"], np.uint8)
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        if len(known) and len(anchor):
            at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
            seen: dict = {}
            for i in np.flatnonzero(known[at] == anchor):
                text = data[place[i] : place[i] + count[i] + LENGTH - 1].tobytes()
                d = int(doc[i])
                owner, first, name = int(chunk.doc[d]), int(start[i] + chunk.key[d]), int(anchor[i])
                if hot[at[i]]:
                    _windows(out, slots, seen, owner, first, text)
                elif seen.setdefault((name, text), i) != i:
                    out.spans.append((owner, first, len(text)))
                else:
                    out.add((name >> 32) % slots, name, owner, first, text)
    return out.table(slots)


def _windows(out: _Out, slots: int, seen: dict, owner: int, first: int, text: bytes) -> None:
    """Each window of a hot anchor's segment goes where its own bytes say."""
    for p in range(len(text) - LENGTH + 1):
        window = text[p : p + LENGTH]
        if window in seen:
            out.spans.append((owner, first + p, LENGTH))
        else:
            seen[window] = True
            name = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little")
            out.add((name >> 32) % slots, name, owner, first + p, window)


def _losers(table: pa.Table) -> pa.Table:
    """Sort the suffixes of a slot; every window that equals an earlier one loses its bytes."""
    kinds = np.array(table["kind"].to_pylist(), np.int64)
    passed = table.filter(pa.array(kinds == SPAN))
    table = table.filter(pa.array(kinds == SEGMENT))
    sizes = counts_of(table["docs"], 8)
    chunk = np.repeat(np.array(table["chunk"].to_pylist(), np.int64), sizes)
    anchor, doc = unblob(table["anchors"], np.uint64), unblob(table["docs"], np.int64)
    start, length = unblob(table["starts"], np.int64), unblob(table["lengths"], np.int32).astype(np.int64)
    data = unblob(table["texts"], np.uint8)
    place = np.cumsum(length) - length
    # In order of place, so that the first of equals is the earliest.
    order = np.lexsort((start, doc))
    chunk, anchor, doc, start, length, place = (x[order] for x in (chunk, anchor, doc, start, length, place))
    group, many = np.unique(anchor, return_inverse=True)[1], None
    many = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
    lost = []  # (segment, first window, bytes)
    todo = np.flatnonzero(many)
    # Whole segments that are equal: one is kept, and its windows alone are sorted on.
    for size in np.unique(length[todo]):
        same = todo[length[todo] == size]
        o, label = deep_shallow(data, place[same], int(size), group[same])
        first = _least_of_label(o, label)
        dead = same[o[o != first]]
        lost.append((dead, np.zeros(len(dead), np.int64), np.full(len(dead), size)))
        many[dead] = False
    todo = np.flatnonzero(many)
    left = np.bincount(group[todo], minlength=len(group) + 1)[group] > 1 if len(group) else many
    todo = todo[left[todo]]
    begin, size = _groups(np.sort(group[todo]))
    todo = todo[np.argsort(group[todo], kind="stable")]
    ends = np.cumsum(size)
    lo = 0
    while lo < len(begin):  # the suffixes of some anchors at a time
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 14), "right")))
        part = todo[begin[lo] : ends[hi - 1]]
        windows = length[part] - LENGTH + 1
        owner = np.repeat(part, windows)
        offset = ranges(np.zeros(len(part), np.int64), windows)
        rank = np.lexsort((offset, owner))  # segments are numbered in order of place
        owner, offset = owner[rank], offset[rank]
        o, label = deep_shallow(data, place[owner] + offset, LENGTH, group[owner])
        dead = o[o != _least_of_label(o, label)]
        lost.append((owner[dead], offset[dead], np.full(len(dead), LENGTH)))
        lo = hi
    seg, offset, size = (np.concatenate(x) for x in zip(*lost)) if lost else (np.zeros(0, np.int64),) * 3
    return _spans(chunk[seg], doc[seg], start[seg] + offset, size, passed)


def _least_of_label(order: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each place of the order, the least element among its equals."""
    begin, size = _groups(label)
    return np.repeat(np.minimum.reduceat(order, begin), size) if len(begin) else order


def _spans(chunk, doc, start, size, passed: pa.Table) -> pa.Table:
    order = np.lexsort((start, doc, chunk))
    chunk, doc, start, size = chunk[order], doc[order], start[order], size[order]
    if len(chunk):  # join windows that follow one another, to send less
        end = start + size
        apart = np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] > end[:-1]) | (start[1:] // ORDINAL != start[:-1] // ORDINAL)])
        first = np.flatnonzero(apart)
        end = np.maximum.reduceat(end, first)
        chunk, doc, start = chunk[first], doc[first], start[first]
        size = end - start
    begin, count = _groups(chunk)
    rows = [(int(chunk[b]), blob(doc[b : b + n]), blob(start[b : b + n]), blob(size[b : b + n].astype(np.int32))) for b, n in zip(begin, count)]
    rows += list(zip(*(passed[c].to_pylist() for c in ("chunk", "docs", "starts", "lengths"))))
    return pa.table(
        {
            "chunk": pa.array([r[0] for r in rows], pa.int32()),
            "kind": pa.array([SPAN] * len(rows), pa.int32()),
            "docs": pa.array([r[1] for r in rows], pa.binary()),
            "data": pa.array([r[2] for r in rows], pa.binary()),
            "more": pa.array([r[3] for r in rows], pa.binary()),
        }
    )


def _mask(chunk: _Chunk) -> np.ndarray:
    """True for each byte of the chunk that goes."""
    edge = np.zeros(len(chunk.data) + 1, np.int32)
    spans = chunk.notes[SPAN]
    doc, start = unblob(spans["docs"], np.int64), unblob(spans["data"], np.int64)
    size = unblob(spans["more"], np.int32)
    place = np.searchsorted(chunk.doc, doc, "left") + start // ORDINAL
    begin = chunk.offsets[place] + start % ORDINAL
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + size, -1)
    gone = np.cumsum(edge[:-1]) > 0
    for i in np.flatnonzero(chunk.copy & (np.diff(chunk.offsets) >= LENGTH)):
        gone[chunk.offsets[i] : chunk.offsets[i + 1]] = True
    return gone


def _results(texts: bool, key, docs: pa.Table, notes: pa.Table) -> pa.Table:
    chunk = _Chunk(docs, notes)
    gone = _mask(chunk)
    unique = []
    for i in range(len(chunk.doc)):
        a, b = chunk.offsets[i], chunk.offsets[i + 1]
        out = gone[a:b]
        kept = chunk.data[a:b][~out].tobytes()
        runs = int(np.count_nonzero(out[1:] & ~out[:-1])) + int(b > a and out[0])
        row = (int(chunk.doc[i]), int(b - a), int(out.sum()), runs, hashlib.sha256(kept).hexdigest())
        # A cut may fall inside a character; as text, what is left of that character goes.
        unique.append(row + ((kept.decode("utf-8", "ignore"),) if texts else ()))
    if texts:  # each row of the chunk, in its order
        place = {(int(chunk.doc[i]), chunk.text(i)): i for i in range(len(chunk.doc))}
        rows = [unique[place[d, (t or "").encode()]] for d, t in zip(ids(docs["doc_id"]).tolist(), docs["text"].to_pylist())]
    else:
        rows = [r for r, n in zip(unique, chunk.repeats) for _ in range(n)]
    found = pa.table(
        {
            "doc_id": id_array(np.array([r[0] for r in rows], np.int64)),
            "n_bytes": pa.array([r[1] for r in rows], pa.int64()),
            "n_removed": pa.array([r[2] for r in rows], pa.int64()),
            "n_spans": pa.array([r[3] for r in rows], pa.int64()),
            "kept_sha256": pa.array([r[4] for r in rows], pa.string()),
        }
    )
    if texts:
        found = found.append_column("kept_text", pa.array([r[5] for r in rows], pa.string())).append_column("row", docs["row"])
    return found


def suffix_dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with ``texts`` also kept_text
    and the other columns of the row."""
    spark = docs.sparkSession
    chunks = chunk_count(spark, docs)
    slots = part_count(docs)  # a chunk sends a row to each
    dealt = with_chunks(docs, chunks, texts)
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    hashes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"))
    copies = not_first(hashes, ["digest"], "doc_id", SALTS).distinct()
    asides = copies.select(
        chunk_of(F.col("doc_id"), chunks).alias("chunk"), F.lit(COPY).alias("kind"),
        _long_bytes(F.coalesce(F.col("doc_id"), F.lit(int(NO_ID)))).alias("docs"), F.col("digest").alias("data"), F.lit(None).cast("binary").alias("more"),
    )
    by_chunk = dealt.groupBy("chunk")

    def with_notes(notes: DataFrame, body, schema: str) -> DataFrame:
        return by_chunk.cogroup(notes.groupBy("chunk")).applyInArrow(body, schema)

    counted = with_notes(asides, freeing(partial(_count_anchors, slots)), "slot int, chunk int, anchors binary, counts binary")
    replies = counted.groupBy("slot").applyInArrow(_repeated_anchors, NOTES)
    sent = with_notes(asides.unionByName(replies), freeing(partial(_send_segments, slots)), SEGMENTS)
    spans = sent.groupBy("slot").applyInArrow(_losers, NOTES)
    result = result_type(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", texts)
    return with_notes(asides.unionByName(spans), freeing(partial(_results, texts)), result)


def _long_bytes(value):
    """The eight little-endian bytes of a long."""
    big = F.unhex(F.lpad(F.hex(value), 16, "0"))
    return F.concat(*[F.substring(big, i, 1) for i in range(8, 0, -1)])
