"""Phrases that stand out, counted in a weighted de Bruijn graph of words.

Texts are split into pieces and words. Blocks of documents ask shards for the numbers of
their words; a shard counts each word over all blocks and numbers those that occur at least
``min_count`` times. Others can be in no candidate and in no part of one, so for the graph
a piece ends there.

An edge of the graph is a window of ``LONGEST`` words, from the node of its first four to
the node of its last four. Windows that the end of a piece cuts short stand for themselves
and are the corrections: what flows out of a node, and the pieces that end in it, are its
count. So the windows are aggregated once, by node; a node's edges and short windows give
its count, the counts of nodes with the same first words give that of the shorter phrase
(plus the pieces that end there), and so on. Each block folds its own windows first, so a
passage or pair of words that all documents share is one entry a block.

Unary paths are compacted: a phrase whose occurrences all go on with the same word, or
follow the same word, has the weight of the longer phrase and is absorbed by it. What is
left are the phrases that no longer one of equal weight holds. ``long_phrases`` follows
unary paths over many edges and gives whole passages.

A phrase is scored where its cut is weakest: a n / (l r) for the counts of the whole, of
both parts and of all words, exactly.

Results for odd input: a null text is empty; a null language is ``und``; repeated rows count
each; ties in score go by count, then by the phrase's bytes; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import freeing, give_back, numbered, spread
from loglens.llm.word_blocks import FOLDED, answers_in_order, by_shard, fold, pack_words, planes, shards_for, unplanes, unpack_codes, unpack_words
from loglens.session import store_table

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: No text in UTF-8 holds this byte; it marks the end of a piece.
END = b"\xff"
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_SPLIT = bytes.maketrans(_BREAKS + b"\t", END * len(_BREAKS) + b" ")
ASKED = "shard int, block long, label string, words binary, counts binary"
#: Answers to a block, or (under a negative block of its own) what a shard found out.
NAMES = "block long, shard int, ids binary"
#: Grams of a shard. What is found is only passed on: grams, or with width 0 words.
GRAMS = "shard int, found boolean, width int, grams binary"
FOUND = "words array<int>, n long, label string, word string"


def split_words(text: str) -> list[bytes]:
    """Words in lower case (A-Z), with END after each piece."""
    return text.encode().lower().translate(_SPLIT).replace(END, b" \xff ").split() + [END]


def _fold(batches):
    return fold(batches, split_words)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(c, kinds[t]) for c, t in zip(columns, types)], list(names))


# --- numbers for words ---


def _ask(shards: int, blocks: pa.Table) -> pa.Table:
    """Each block tells every shard its words and how often it has them."""
    rows = []
    for r in blocks.to_pylist():
        words = unpack_words(r["words"])
        counts = np.bincount(unpack_codes(r["codes"]), minlength=len(words))
        for shard, mine in by_shard(words, shards):
            packed = pack_words([words[i] for i in mine.tolist()])
            rows.append((shard, r["block"], r["label"], packed, zstandard.compress(planes(counts[mine]), 1)))
    return _table(rows, ASKED)


def _name(min_count: int, shards: int, asked: pa.Table) -> pa.Table:
    """A shard counts its words over all blocks, numbers the frequent ones (the most frequent
    first, as small numbers pack well) and answers each block; 0 stands for all others."""
    total: dict[tuple, int] = {}
    per_label: dict = {}
    told = []
    for r in asked.to_pylist():
        words = unpack_words(r["words"])
        told.append((r["block"], r["shard"], r["label"], words))
        label = r["label"]
        for w, n in zip(words, unplanes(zstandard.decompress(r["counts"]), np.int64).tolist()):
            if w != END:
                total[label, w] = total.get((label, w), 0) + n
    for (label, _), n in total.items():
        per_label[label] = per_label.get(label, 0) + n
    frequent = sorted((key for key, n in total.items() if n >= min_count), key=lambda x: (-total[x], x))
    shard = told[0][1]
    number = {key: 1 + k * shards + shard for k, key in enumerate(frequent)}
    learnt = {label: {"total": n, "words": [], "ids": [], "n": []} for label, n in per_label.items()}
    for label, w in frequent:
        of = learnt[label]
        of["words"].append(w.decode())
        of["ids"].append(number[label, w])
        of["n"].append(total[label, w])
    rows = [(-1 - shard, shard, zstandard.compress(json.dumps(list(learnt.items())).encode()))]
    for block, _, label, words in told:
        found = np.fromiter((number.get((label, w), 0) for w in words), "<i4", len(words))
        rows.append((block, shard, zstandard.compress(planes(found), 1)))
    return _table(rows, NAMES)


# --- counts of phrases ---


def pack_grams(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Numbers of words and counts; first words mostly rise, so their steps are kept."""
    steps = np.diff(columns[0], prepend=0)
    parts = [planes(c.astype("<i4")) for c in (steps, *columns[1:])] + [planes(n.astype("<i8"))]
    return zstandard.compress(b"".join(parts), 1)


def unpack_grams(data: bytes, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = zstandard.decompress(data)
    size = len(raw) // (4 * width + 8)
    at = 4 * size
    columns = [unplanes(raw[at * k : at * (k + 1)], "<i4").astype(np.int64) for k in range(width)]
    columns[0] = np.cumsum(columns[0])
    return columns, unplanes(raw[at * width :], "<i8")


def _dealt(columns: list[np.ndarray], n: np.ndarray, key: int, shards: int) -> list[tuple]:
    """Rows of GRAMS, dealt by the first ``key`` words."""
    mixed = np.zeros(len(n), np.uint64)
    for c in columns[:key]:
        mixed = spread(mixed * np.uint64(31) + c.astype(np.uint64))
    shard = (mixed >> np.uint64(33)).astype(np.int64) % shards
    order = np.argsort(shard, kind="stable")
    found, starts = np.unique(shard[order], return_index=True)
    parts = np.split(order, starts[1:]) if len(found) else []
    return [(s, False, len(columns), pack_grams([c[p] for c in columns], n[p])) for s, p in zip(found.tolist(), parts)]


def _windows(shards: int, blocks: pa.Table, names: pa.Table) -> pa.Table:
    """The windows of a block, each with its number of occurrences."""
    if not blocks.num_rows:
        return _table([(s, True, 0, x) for s, x in zip(names.column("shard").to_pylist(), names.column("ids").to_pylist())], GRAMS)
    told = {s: unplanes(zstandard.decompress(x), "<i4").tolist() for s, x in zip(names.column("shard").to_pylist(), names.column("ids").to_pylist())}
    rows = []
    for r in blocks.to_pylist():
        words = unpack_words(r["words"])
        ids = np.array(answers_in_order(words, shards, told), np.int64)
        line = np.append(ids[unpack_codes(r["codes"])], np.zeros(LONGEST, np.int64))
        # Lone words are counted with the numbers.
        at = np.flatnonzero((line[:-1] > 0) & (line[1:] > 0))
        columns = [line[at]]
        for k in range(1, LONGEST):
            columns.append(np.where(columns[-1] > 0, line[at + k], 0))
        if not len(at):
            continue
        number = columns[0]
        for c in columns[1:]:
            number, counts = numbered(number, c)
        first = np.empty(len(counts), np.int64)
        first[number] = np.arange(len(number))
        rows += _dealt([c[first] for c in columns], counts, LONGEST - 1, shards)
    return _table(rows, GRAMS)


def _sorted_sums(columns: list[np.ndarray], n: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums over equal first ``width`` words of sorted rows."""
    new = np.zeros(len(n), bool)
    new[:1] = True
    for c in columns[:width]:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns[:width]], np.add.reduceat(n, at) if len(at) else n


def _flow(widths: tuple[int, ...], min_count: int, shards: int, grams: pa.Table) -> pa.Table:
    """Counts of the phrases of the given numbers of words, longest first, and what the next
    shorter ones get from them."""
    rows = [(s, True, w, g) for s, f, w, g in zip(*(grams.column(c).to_pylist() for c in ("shard", "found", "width", "grams"))) if f]
    parts = [unpack_grams(g, w) for f, w, g in zip(*(grams.column(c).to_pylist() for c in ("found", "width", "grams"))) if not f]
    if parts:
        columns = [np.concatenate(c) for c in zip(*(p[0] for p in parts))]
        n = np.concatenate([p[1] for p in parts])
        keys = [(columns[k] << 32) | columns[k + 1] if k + 1 < len(columns) else columns[k] for k in range(0, len(columns), 2)]
        order = np.lexsort(keys[::-1])
        columns, n = [c[order] for c in columns], n[order]
        shard = grams.column("shard")[0].as_py()
        for width in widths:
            columns, n = _sorted_sums(columns, n, width)
            often = np.flatnonzero((columns[-1] > 0) & (n >= min_count))
            if len(often):
                rows.append((shard, True, width, pack_grams([c[often] for c in columns], n[often])))
        if width > 2:
            columns, n = _sorted_sums(columns, n, width - 1)
            rows += _dealt(columns, n, width - 1, shards)
    return _table(rows, GRAMS)


def _unpack(batches):
    """Rows of FOUND: phrases; words with their label; and the total of each label."""
    for batch in batches:
        for width, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if width:
                columns, n = unpack_grams(data, width)
                flat = np.stack(columns, 1).astype(np.int32).ravel()
                labels = words = pa.nulls(len(n), pa.string())
            else:
                learnt = json.loads(zstandard.decompress(data))
                flat = np.array([i for _, of in learnt for i in of["ids"]], np.int32)
                labels = pa.array([label for label, of in learnt for _ in of["ids"]], pa.string())
                words = pa.array([w for _, of in learnt for w in of["words"]], pa.string())
                n = np.array([x for _, of in learnt for x in of["n"]], np.int64)
                none = [pa.nulls(len(learnt), t) for t in (pa.list_(pa.int32()), pa.string())]
                totals = [pa.array([of["total"] for _, of in learnt], pa.int64()), pa.array([label for label, _ in learnt], pa.string())]
                yield _found(none[0], totals[0], totals[1], none[1])
            offsets = pa.array(np.arange(0, len(flat) + 1, width or 1, dtype=np.int32))
            yield _found(pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(n), labels, words)


def _found(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), ["words", "n", "label", "word"])


def _on_table(body, *arguments):
    """applyInArrow looks at the number of arguments."""

    def call(table):
        try:
            return body(*arguments, table)
        finally:
            give_back()

    return call


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the phrases that occur ``min_count`` times or more: (words as numbers, n); (id, label, word);
    and n, the number of all words of each label (language)."""
    shards = shards_for(docs)
    label = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), label)
    blocks = rows.mapInArrow(_fold, FOLDED).select("block", "codes", "words", "label").groupBy("block")
    asked = blocks.applyInArrow(_on_table(_ask, shards), ASKED)
    names = asked.groupBy("shard").applyInArrow(_on_table(_name, min_count, shards), NAMES)

    def windows(key, left, right):
        return _windows(shards, left, right)

    grams = blocks.cogroup(names.groupBy("block")).applyInArrow(freeing(windows), GRAMS)
    for widths in ((5, 4), (3,), (2,)):
        grams = grams.groupBy("shard").applyInArrow(_on_table(_flow, widths, min_count, shards), GRAMS)
    found = store_table(grams.select("width", "grams").mapInArrow(_unpack, FOUND), "phrase-counts")
    words = found.filter("word IS NOT NULL").select(F.element_at("words", 1).alias("id"), "label", "word")
    totals = found.filter("words IS NULL").groupBy("label").agg(F.sum("n").alias("total"))
    return found.filter("words IS NOT NULL").select("words", "n"), words, totals


# --- unary paths ---


def _dealt_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the corpus, so both are dealt by its key.

    Spark expects of a stored table what its packed files hold. Phrases take over ten times that
    as rows, and a table it takes for small would go whole through the driver to every executor.
    """
    return left.join(right.hint("merge"), on, how)


def _shorter(longer: DataFrame) -> DataFrame:
    """Both phrases that a longer one extends by a word."""
    size = F.size("words")
    sides = F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))
    return longer.select(F.explode(sides).alias("inner"), F.col("n").alias("longer_n"))


def compacted(phrases: DataFrame) -> DataFrame:
    """Phrases of two words or more that no longer one of equal weight absorbs.

    A longer phrase never occurs more often than what it holds, so where one of equal weight
    exists, so does one that is a single word longer.
    """
    multiple = phrases.filter(F.size("words") > 1)
    most = _shorter(multiple).groupBy("inner").agg(F.max("longer_n").alias("longer_n"))
    joined = _dealt_join(multiple, most, F.col("words") == F.col("inner"), "left")
    return joined.filter("longer_n IS NULL OR longer_n < n").select("words", "n")


def long_phrases(phrases: DataFrame) -> DataFrame:
    """Unary paths as one phrase each: (words, n). Edges follow each other in a path where both
    have the weight of the node between them; paths are joined by doubling steps."""
    edges = phrases.filter(F.size("words") == LONGEST)
    nodes = phrases.filter(F.size("words") == LONGEST - 1).select(F.col("words").alias("node"), F.col("n").alias("node_n"))
    into = edges.select(F.col("words").alias("edge"), "n", F.slice("words", 2, LONGEST - 1).alias("node"))
    out = edges.select(F.col("words").alias("after"), F.col("n").alias("after_n"), F.slice("words", 1, LONGEST - 1).alias("node"))
    steps = into.join(nodes.filter("node_n IS NOT NULL"), "node").filter("n = node_n").join(out, "node").filter("n = after_n")
    # (edge, the edge so many steps before it, steps); heads stay with themselves.
    jump = edges.select(F.col("words").alias("edge"), "n").join(
        steps.select(F.col("after").alias("edge"), F.col("edge").alias("back")), "edge", "left"
    )
    jump = jump.select("edge", "n", F.coalesce("back", "edge").alias("back"), F.when(F.col("back").isNull(), 0).otherwise(1).alias("steps"))
    jump = store_table(jump, "path-steps")
    while True:
        further = jump.select(F.col("edge").alias("back"), F.col("back").alias("next"), F.col("steps").alias("more"))
        doubled = jump.join(further, "back").select("edge", "n", F.col("next").alias("back"), (F.col("steps") + F.col("more")).alias("steps"))
        moved = doubled.agg(F.sum("steps")).first()[0]
        before = jump.agg(F.sum("steps")).first()[0]
        if moved == before:
            break
        jump = store_table(doubled, "path-steps")
    last = F.transform(F.array_sort(F.collect_list(F.struct("steps", F.element_at("edge", -1).alias("word")))), lambda x: x["word"])
    paths = jump.groupBy("back", "n").agg(last.alias("last"))
    return paths.select(F.concat(F.slice("back", 1, LONGEST - 1), "last").alias("words"), "n")


# --- scores ---


def _decimal(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    phrases, words, totals = phrase_counts(docs, min_count)
    left = compacted(phrases).withColumnRenamed("n", "a")
    spelled = _dealt_join(left.select("words", "a", F.posexplode("words").alias("place", "id")), words, "id")
    spelled = spelled.groupBy("words", "a", "label").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("parts"))
    spelled = spelled.select("words", "a", "label", F.array_join(F.transform("parts", lambda x: x["word"]), " ").alias("phrase"))
    scored = spelled.join(totals, "label")
    cuts = scored.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumn("head", F.slice("words", F.lit(1), F.col("k"))).withColumn(
        "rest", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))
    )
    heads = phrases.select(F.col("words").alias("head"), F.col("n").alias("l"))
    rests = phrases.select(F.col("words").alias("rest"), F.col("n").alias("r"))
    cuts = _dealt_join(_dealt_join(cuts, heads, "head"), rests, "rest")
    top_part = (_decimal("a") * _decimal("total")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    low_part = (_decimal("l") * _decimal("r")).cast("decimal(38,0)")
    cuts = cuts.withColumn("above", top_part.cast("decimal(38,0)")).withColumn("below", low_part)
    cuts = cuts.withColumn("score", F.expr("above div below"))
    worst = cuts.groupBy("label", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = "score DESC, a DESC, phrase"
    worst = worst.select(F.col("label").alias("lang"), "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    ranked = worst.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang ORDER BY {order})")).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
