"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its windows of five words. A shingle's weight is its count in the
text times a damped inverse document frequency, 1 + ``IDF_SPAN`` ln(N / df) / ln(N), with df
over all distinct texts; the damping keeps a large family of near copies, whose shared
shingles are frequent because of the family itself, from being torn apart. Two texts are
linked when their weighted Jaccard similarity (sum of lesser weights over sum of greater
ones) is at least ``SIMILARITY``; classes are the connected texts, named by their smallest
doc_id.

1. Equal texts share a digest and are one text from here on.
2. Each chunk of documents asks the shards of shingles once for the df of each of its own.
3. A text can be linked only if shingles that other texts hold, too, make up
   ``SIMILARITY`` of its weight; others are left out, exactly.
4. The rest are sampled: for each of ``BANDS`` x ``ROWS`` samples the shingle of least
   ln c - r (floor(ln w / r + b) - b) - r, where r, c ~ Gamma(2, 1) and b ~ U(0, 1) come from
   a table by the shingle's hash. Texts that agree in all rows of a band share a bucket.
5. In each bucket every member is compared with one centre, so a bucket of n texts gives
   n - 1 pairs. Pairs are verified by the weighted Jaccard similarity itself.
6. Links are merged to classes. Buckets that still hold several classes are taken again:
   members outside the centre's class are compared with a centre of their own and with
   another member of the first class, until no new pair links.
7. Where a bucket still holds several classes then, all its members of different classes
   are compared. Its members are dealt into blocks of about ``BLOCK``; a task compares two
   blocks in memory and gives one link for each two classes that it joins.

A bucket with very many members is only ever the hot side of an equi-join with one row
for each bucket, which Spark splits; its pairs of blocks are spread over tasks, and its
pairs of members are never rows.

Results for odd input: null text is empty; texts of fewer than five words have no shingle
and are linked to equal texts only; rows that share a doc_id are judged by their texts; a
null doc_id names a class only if it has no other; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import (
    NO_ID, blob, chunk_count, chunk_of, freeing, not_first, packed, part_count, parts, spread, unblob, windows_of, with_chunks, word_hashes,
)
from loglens.llm.suffix_dedup import COPY, SALTS, _Chunk, _long_bytes
from loglens.session import store_table

WORDS = 5
SIMILARITY = 0.8
IDF_SPAN = 0.1
BANDS, ROWS = 26, 5
DIGEST = 16
KEY_BITS = 40  # of a shingle's hash inside its shard
SHINGLES_AT_ONCE = 1 << 16
BLOCK = 128

ASKED = "slot int, chunk int, keys binary"
NOTES = "chunk int, kind int, docs binary, data binary, more binary"
DF = 4
VECTORS = "node binary, weight double, keys binary, weights binary, bands array<long>"


# --- shingles ---


def shingles(data: np.ndarray, offsets: np.ndarray):
    """Distinct shingles of each text with their counts, in order of (text, hash)."""
    hashes, owner, _ = word_hashes(data, offsets)
    window, place = windows_of(hashes, owner, WORDS)
    owner = owner[place]
    order = np.lexsort((window, owner))
    window, owner = window[order], owner[order]
    new = np.concatenate([[True], (window[1:] != window[:-1]) | (owner[1:] != owner[:-1])]) if len(window) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return window[begin], owner[begin], np.diff(np.concatenate([begin, [len(window)]]))


def _all_shingles(chunk: _Chunk):
    """(document, hash, count) of all shingles of a chunk's documents that copy no other."""
    keep = np.flatnonzero(~chunk.copy)
    found = []
    for lo, hi in parts(np.diff(chunk.offsets)[keep], 1 << 20):
        rows = keep[lo:hi]
        data = np.concatenate([chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]] for i in rows])
        offsets = np.concatenate([[0], np.cumsum(np.diff(chunk.offsets)[rows])])
        window, owner, count = shingles(data, offsets)
        found.append((rows[owner], window, count))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _slots_of(window: np.ndarray, slots: int) -> np.ndarray:
    return ((window >> np.uint64(KEY_BITS)) % np.uint64(slots)).astype(np.int64)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The bytes of numbers, all first bytes, then all second ones, and so on."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplane(data: bytes, width: int) -> np.ndarray:
    part = np.frombuffer(data, np.uint8).reshape(width, -1)
    wide = np.zeros((part.shape[1], 8), np.uint8)
    wide[:, :width] = part.T
    return wide.reshape(-1).view("<u8")


def _wanted(window: np.ndarray, slots: int):
    """For each slot: its distinct keys, sorted, and how many of the chunk's texts hold each."""
    slot = _slots_of(window, slots)
    key = window & np.uint64((1 << KEY_BITS) - 1)
    order = np.lexsort((key, slot))
    slot, key = slot[order], key[order]
    new = np.concatenate([[True], (slot[1:] != slot[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    count = np.diff(np.concatenate([begin, [len(key)]]))
    return slot[begin], key[begin], count, order, np.cumsum(new) - 1


def _ask(slots: int, key, docs: pa.Table, notes: pa.Table) -> pa.Table:
    rows = []
    if docs.num_rows:
        slot, keys, count, *_ = _wanted(_all_shingles(_Chunk(docs, notes))[1], slots)
        ends = np.cumsum(np.bincount(slot, minlength=slots)) if len(slot) else np.zeros(slots, np.int64)
        for s in range(slots):
            a, b = (ends[s - 1] if s else 0), ends[s]
            if b > a:
                rows.append((s, _planes(keys[a:b], 5) + _planes(count[a:b], 4)))
    return pa.table(
        {
            "slot": pa.array([r[0] for r in rows], pa.int32()),
            "chunk": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "keys": pa.array([r[1] for r in rows], pa.binary()),
        }
    )


def _frequencies(key, table):
    """Answers each request of a slot with the document frequencies, in the order asked."""
    rows = table.to_pylist()
    sizes = [len(r["keys"]) // 9 for r in rows]
    keys = np.concatenate([_unplane(r["keys"][: 5 * n], 5) for r, n in zip(rows, sizes)])
    count = np.concatenate([_unplane(r["keys"][5 * n :], 4) for r, n in zip(rows, sizes)]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    total = np.add.reduceat(count[order], begin)
    df = np.empty(len(keys), np.int64)
    df[order] = np.repeat(total, np.diff(np.concatenate([begin, [len(keys)]])))
    ends = np.cumsum(sizes)
    return pa.table(
        {
            "chunk": pa.array([r["chunk"] for r in rows], pa.int32()),
            "kind": pa.array([DF] * len(rows), pa.int32()),
            "docs": pa.nulls(len(rows), pa.binary()),
            "data": pa.array([_planes(df[e - n : e], 4) for e, n in zip(ends, sizes)], pa.binary()),
            "more": pa.array([blob(np.array([key[0].as_py()], np.int32))] * len(rows), pa.binary()),
        }
    )


# --- sampling ---


def _tables():
    """r, ln c and b of the sampling, by 16 bits of a hash."""
    rng = np.random.default_rng(20)
    return rng.gamma(2, 1, 1 << 16), np.log(rng.gamma(2, 1, 1 << 16)), rng.random(1 << 16)


GAMMA, LN_C, BETA = _tables()
FACTORS = spread(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def samples(window: np.ndarray, weight: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of BANDS x ROWS samples for each text; its shingles begin at ``begin``, sorted by hash."""
    log_w = np.log(weight)
    size = np.diff(np.concatenate([begin, [len(window)]]))
    out = np.empty((len(begin), BANDS * ROWS), np.uint64)
    owner = np.repeat(np.arange(len(begin)), size)
    for k, factor in enumerate(FACTORS):
        at = ((window * factor) >> np.uint64(48)).astype(np.int64)
        r, b = GAMMA[at], BETA[at]
        t = np.floor(log_w / r + b)
        a = LN_C[at] - r * (t - b) - r
        least = np.flatnonzero(a == np.minimum.reduceat(a, begin)[owner])
        first = least[np.unique(owner[least], return_index=True)[1]]  # ties to the least hash
        out[:, k] = spread(window[first] ^ spread(t[first].astype(np.int64).astype(np.uint64) + factor))
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    total = np.zeros((len(sample), BANDS), np.uint64)
    for row in range(ROWS):
        total = spread(total ^ sample[:, row::ROWS])
    return spread(total + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def weights(count: np.ndarray, df: np.ndarray, total: int) -> np.ndarray:
    return count * (1 + IDF_SPAN * np.log(total / np.minimum(df, total)) / np.log(max(total, 2)))


def _vectors(slots: int, total: int, key, docs: pa.Table, notes: pa.Table) -> pa.Table:
    """Shared shingles, weights and buckets of the texts of a chunk that may have a link."""
    rows: list[tuple] = []
    kinds = np.array(notes["kind"].to_pylist(), np.int64)
    answers = notes.filter(pa.array(kinds == DF))
    if docs.num_rows and answers.num_rows:
        chunk = _Chunk(docs, notes.filter(pa.array(kinds == COPY)))
        doc, window, count = _all_shingles(chunk)
        slot, _, _, order, place = _wanted(window, slots)
        by_slot = {int(np.frombuffer(m, np.int32)[0]): d for m, d in zip(answers["more"].to_pylist(), answers["data"].to_pylist())}
        # In the order asked: by slot, and sorted in it.
        asked = np.concatenate([_unplane(by_slot[s], 4) for s in sorted(by_slot)]).astype(np.int64)
        df = np.empty(len(window), np.int64)
        df[order] = asked[place]
        weight = weights(count, df, total)
        sums = np.bincount(doc, weights=weight, minlength=len(chunk.doc))
        shared = np.bincount(doc, weights=weight * (df > 1), minlength=len(chunk.doc))
        able = (shared >= SIMILARITY * sums * (1 - 1e-9)) & (sums > 0)
        rows = _sampled(chunk, doc, window, weight, df, sums, able)
    return pa.table(
        {
            "node": pa.array([r[0] for r in rows], pa.binary()),
            "weight": pa.array([r[1] for r in rows], pa.float64()),
            "keys": pa.array([r[2] for r in rows], pa.binary()),
            "weights": pa.array([r[3] for r in rows], pa.binary()),
            "bands": pa.array([r[4] for r in rows], pa.list_(pa.int64())),
        }
    )


def _sampled(chunk: _Chunk, doc, window, weight, df, sums, able) -> list[tuple]:
    import hashlib

    keep = able[doc]
    doc, window, weight, df = doc[keep], window[keep], weight[keep], df[keep]
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([begin, [len(doc)]]))
    rows = []
    for lo, hi in parts(size, SHINGLES_AT_ONCE):
        a, b = begin[lo], begin[hi - 1] + size[hi - 1]
        bands = band_keys(samples(window[a:b], weight[a:b], begin[lo:hi] - a))
        for j in range(lo, hi):
            part = slice(begin[j], begin[j] + size[j])
            i = int(doc[begin[j]])
            two = df[part] > 1  # shingles of this text alone are in its whole weight only
            key = window[part][two] & np.uint64((1 << KEY_BITS) - 1)
            by = np.argsort(key)
            node = hashlib.sha256(chunk.text(i)).digest()[:DIGEST]
            rows.append((node, float(sums[i]), _planes(key[by], 5), blob(weight[part][two][by].astype(np.float32)), bands[j - lo]))
    return rows


def similarity(a: dict, b: dict) -> float:
    """Weighted Jaccard similarity of two rows of VECTORS."""
    x, y = _unplane(a["keys"], 5), _unplane(b["keys"], 5)
    at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
    hit = y[at] == x if len(y) else np.zeros(len(x), bool)
    lesser = np.minimum(np.frombuffer(a["weights"], np.float32)[hit], np.frombuffer(b["weights"], np.float32)[at[hit]])
    common = float(lesser.sum(dtype=np.float64))
    return common / max(a["weight"] + b["weight"] - common, 1e-300)


def _verify(batches):
    for batch in batches:
        rows = batch.to_pylist()
        sims = [
            similarity(
                {"keys": r["a_keys"], "weights": r["a_weights"], "weight": r["a_weight"]},
                {"keys": r["b_keys"], "weights": r["b_weights"], "weight": r["b_weight"]},
            )
            for r in rows
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[n] for r in rows], pa.binary()) for n in ("a", "b")] + [pa.array(sims, pa.float64())], ["a", "b", "sim"]
        )


# --- pairs and classes ---


def _measured(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """a, b, sim of pairs of texts."""

    def side(name: str) -> DataFrame:
        return vectors.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("weight", "keys", "weights")))

    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_verify, "a binary, b binary, sim double")


def merge(links: DataFrame, name: str) -> DataFrame:
    """node, label of every linked node: the least node of its connected part. Each round
    hooks nodes to the least neighbour, jumps once, and goes on with the links between labels."""
    both = links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    labels = both.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().withColumn("label", F.col("node"))
    edges = both
    while True:
        edges = store_table(edges, f"{name}-edges")
        if edges.isEmpty():
            return labels
        parent = edges.groupBy("hi").agg(F.min("lo").alias("up"))
        jump = parent.select(F.col("hi").alias("up"), F.col("up").alias("top"))
        parent = store_table(parent.join(jump, "up", "left").select("hi", F.coalesce("top", "up").alias("up")), f"{name}-parents")

        def moved(table: DataFrame, column: str) -> DataFrame:
            step = parent.select(F.col("hi").alias(column), F.col("up").alias("new"))
            return table.join(step, column, "left").withColumn(column, F.coalesce("new", column)).drop("new")

        labels = store_table(moved(labels, "label"), f"{name}-labels")
        edges = moved(moved(edges, "lo"), "hi").filter(F.col("lo") != F.col("hi"))
        edges = edges.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct()


def _star(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the least member."""
    centre = members.groupBy("band", "bucket").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last").drop("last")
    return members.join(centre, ["band", "bucket"]).filter("node > a").select("a", F.col("node").alias("b")).distinct()


def _again(members: DataFrame, labels: DataFrame, measured: DataFrame) -> DataFrame:
    """New pairs of the buckets that hold several classes."""
    known = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = known.groupBy("band", "bucket").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.max("node").alias("any"))
    mixed = mixed.filter("first < last").drop("last", "any")
    rest = known.join(mixed, ["band", "bucket"])
    inside = rest.filter("label = first").groupBy("band", "bucket").agg(F.max("node").alias("inner"))
    outside = rest.filter("label > first")
    centre = outside.groupBy("band", "bucket").agg(F.min_by("node", F.struct("label", "node")).alias("outer"), F.min("label").alias("outer_label"))
    both = outside.join(inside.join(centre, ["band", "bucket"]), ["band", "bucket"])
    pairs = both.select(F.explode(F.array(F.struct(F.col("inner").alias("x"), F.col("node").alias("y")), F.struct(F.when(F.col("label") != F.col("outer_label"), F.col("outer")).alias("x"), F.col("node").alias("y")))).alias("p"))
    pairs = pairs.select("p.*").filter("x IS NOT NULL AND x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.join(measured.select("a", "b"), ["a", "b"], "left_anti")


def _blocks(members: DataFrame, labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """The members of the buckets that hold several classes, once for each pair of blocks that
    their block is in. Buckets of the same members are taken once; two alone were compared."""
    known = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = known.groupBy("band", "bucket").agg(
        F.min("label").alias("first"), F.max("label").alias("last"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("mix"), F.sum(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 31))).alias("total"),
    ).filter("first < last AND n > 2")
    once = mixed.groupBy("n", "mix", "total").agg(F.min(F.struct("band", "bucket")).alias("at"))
    once = once.select("at.*", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = known.join(once, ["band", "bucket"]).withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", "label", "block", "band", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return rows.join(vectors.select("node", "weight", "keys", "weights"), "node")


def _compared(key, table):
    """a, b, sim for each two classes with a linked pair of members in two blocks."""
    rows = table.drop_columns(["weights", "keys"]).to_pylist()
    keys = [_unplane(x, 5) for x in table["keys"].to_pylist()]
    weights_ = [np.frombuffer(x, np.float32).astype(np.float64) for x in table["weights"].to_pylist()]
    whole = np.array([r["weight"] for r in rows])
    label = np.unique([r["label"].hex() for r in rows], return_inverse=True)[1]
    left = [n for n, r in enumerate(rows) if r["block"] == r["i"]]
    right = np.array([n for n, r in enumerate(rows) if r["block"] == r["j"]], np.int64)
    found: dict[tuple, tuple] = {}
    if left and len(right) and label.min() < label.max():
        size = np.array([len(keys[n]) for n in right])
        begin = np.cumsum(size) - size
        every, code = np.unique(np.concatenate([keys[n] for n in right]), return_inverse=True)
        theirs = np.concatenate([weights_[n] for n in right])
        mine = np.zeros(len(every))
        for n in left:
            able = (label[right] != label[n]) & (np.minimum(whole[right], whole[n]) >= SIMILARITY * (1 - 1e-9) * np.maximum(whole[right], whole[n]))
            if not able.any():
                continue
            at = np.minimum(np.searchsorted(every, keys[n]), len(every) - 1)
            hit = every[at] == keys[n]
            mine[at[hit]] = weights_[n][hit]
            common = np.add.reduceat(np.minimum(mine[code], theirs), begin)
            mine[at[hit]] = 0
            sim = common / np.maximum(whole[n] + whole[right] - common, 1e-300)
            for m in np.flatnonzero(able & (sim >= SIMILARITY)):
                a, b = sorted((n, int(right[m])), key=lambda x: rows[x]["node"])
                found.setdefault(tuple(sorted((label[a], label[b]))), (rows[a]["node"], rows[b]["node"], float(sim[m])))
    return pa.table({n: pa.array([r[k] for r in found.values()], t) for k, (n, t) in enumerate((("a", pa.binary()), ("b", pa.binary()), ("sim", pa.float64())))})


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_digest, class_id of each row; class_id is the smallest doc_id of its class."""
    spark = docs.sparkSession
    chunks, slots = chunk_count(spark, docs), part_count(docs)
    total = docs.count()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    copies = not_first(hashes, ["digest"], "doc_id", SALTS).distinct()
    asides = copies.select(
        chunk_of(F.col("doc_id"), chunks).alias("chunk"), F.lit(COPY).alias("kind"),
        _long_bytes(F.coalesce(F.col("doc_id"), F.lit(int(NO_ID)))).alias("docs"), F.col("digest").alias("data"), F.lit(None).cast("binary").alias("more"),
    )
    by_chunk = with_chunks(docs, chunks).groupBy("chunk")
    asked = by_chunk.cogroup(asides.groupBy("chunk")).applyInArrow(freeing(partial(_ask, slots)), ASKED)
    answers = asked.groupBy("slot").applyInArrow(_frequencies, NOTES)
    notes = asides.unionByName(answers)
    vectors = by_chunk.cogroup(notes.groupBy("chunk")).applyInArrow(freeing(partial(_vectors, slots, total)), VECTORS)
    # A text may be left in two chunks when equal texts share their least doc_id's place: one is enough.
    vectors = store_table(vectors, "vectors")
    members = store_table(vectors.select("node", F.posexplode("bands").alias("band", "bucket")), "buckets")
    measured = store_table(_measured(_star(members), vectors), "measured")
    while True:
        labels = merge(measured.filter(F.col("sim") >= SIMILARITY), "classes")
        fresh = store_table(_measured(_again(members, labels, measured), vectors), "measured")
        if fresh.isEmpty():
            break
        measured = measured.unionByName(fresh)
        if fresh.filter(F.col("sim") >= SIMILARITY).isEmpty():
            break
    blocks = _blocks(members, labels, vectors).groupBy("band", "bucket", "i", "j")
    fresh = store_table(blocks.applyInArrow(_compared, "a binary, b binary, sim double"), "compared")
    if not fresh.isEmpty():
        labels = merge(measured.unionByName(fresh).filter(F.col("sim") >= SIMILARITY), "classes")
    node = F.substring("digest", 1, DIGEST)
    texts = hashes.groupBy(node.alias("node")).agg(F.min("doc_id").alias("doc_id"))
    named = texts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = labels.join(texts, "node").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = named.join(classes, "label", "left").select("node", F.coalesce("class_id", "doc_id").alias("class_id"))
    return hashes.withColumn("node", node).join(named, "node").select("doc_id", F.lower(F.hex("digest")).alias("text_digest"), "class_id")
