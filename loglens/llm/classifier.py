"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is over the bytes of trusted text (documents that every label row calls good
and not toxic). Grams of ``ORDER`` bytes are counted in each chunk of documents and summed;
the lower orders count in how many ways a gram is preceded. Discounts come from the counts
of counts of each order; a gram's probability is its discounted share plus the weight of
its context times the probability one order below.

Scoring is a join on shards of grams: each chunk asks once for every gram it holds, of all
orders, packed and without repeats; the shards answer with probabilities and context
weights in the order asked; the chunk backs off where a gram was never seen and sums the
logarithms for each document. Its perplexity is per byte, drawn towards the mean of the
trusted documents of its language as if ``PRIOR`` bytes of such text had been read before,
so that a short text is not judged by a few bytes. A mean over a document does not show a
few words that stand out, so the worst word is kept, too: the greatest mean per byte of a
word of ``WORD_BYTES`` bytes or more, counted with the byte behind it.

Half of the trusted documents (by a hash of the id) train the model. The others, which it
has not seen, give the limits: a document is rejected when its perplexity lies above the
limit of its language, a quantile of the held-out ones with a margin, or when its worst word
lies above the limit of worst words, made likewise. A language with fewer than ``FEW``
held-out documents uses the limits of all.

Results for odd input: null text is empty, and an empty text is never rejected; a null
lang is a language of its own; a document with labels that disagree is not trusted; rows
that repeat doc_id and text are scored each, and count once in the model; without any
trusted document nothing is rejected and perplexities are null; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import NO_ID, blob, chunk_of, freeing, id_array, ids, packed, part_count, parts, ranges, spread
from loglens.session import store_table

ORDER = 5
PRIOR = 200
QUANTILE, MARGIN = 0.995, 0.1
WORD_BYTES, WORD_MARGIN = 5, 0.1
WORD_ENDS = np.zeros(256, bool)
WORD_ENDS[list(b"\t\n\r ,.")] = True
FEW = 50
BEGIN = 0xFF  # a byte that UTF-8 never holds stands before a text
BYTES_AT_ONCE = 1 << 20
BYTES = 257.0  # what may come next
LOW = (1 << (8 * ORDER)) - 1
PRIME = 1000003

COUNTS = "gram long, n long"
ASKED = "shard int, chunk int, grams binary"
ANSWER = "chunk int, shard int, chances binary, weights binary"
SCORES = "doc_id long, text_key long, lang string, n_bytes long, trusted boolean, held_out boolean, cross double, worst double"


# --- grams of packed texts; a gram of k bytes is a number of 8 k bits, the last byte lowest, and k above ---


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each byte of the texts and at each text's end (a zero
    byte stands for it), and the offsets of the texts among them."""
    sizes = np.diff(offsets)
    n = len(sizes)
    wide = sizes + ORDER  # ORDER - 1 begin marks before, an end mark behind
    start = np.cumsum(wide) - wide
    padded = np.full(int(wide.sum()), BEGIN, np.uint8)
    padded[ranges(start + ORDER - 1, sizes)] = data
    padded[start + wide - 1] = 0
    value = np.zeros(len(padded), np.int64)
    for back in range(ORDER):
        value[ORDER - 1 :] |= padded[ORDER - 1 - back : len(padded) - back].astype(np.int64) << (8 * back)
    keep = ranges(start + ORDER - 1, sizes + 1)
    return value[keep], np.concatenate([[0], np.cumsum(sizes + 1)]) if n else np.zeros(1, np.int64)


def worst_words(nats: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The greatest mean of a long word of each text; ``at`` are the offsets of the texts in
    ``nats``, which have one more for each text's end."""
    last = np.zeros(len(nats), bool)
    last[at[1:] - 1] = True
    ends = last.copy()
    ends[~last] = WORD_ENDS[data]
    begin = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    size = np.diff(np.concatenate([begin, [len(nats)]]))
    mean = np.where(size >= WORD_BYTES, np.add.reduceat(nats, begin) / size, 0.0)
    return np.maximum.reduceat(mean, np.searchsorted(begin, at[:-1]))


def shorter(gram: np.ndarray, order: int) -> np.ndarray:
    """The last bytes of grams."""
    return gram & ((1 << (8 * order)) - 1)


def _train_part(doc: np.ndarray) -> np.ndarray:
    return (spread(doc.astype(np.uint64)) >> np.uint64(40)) % np.uint64(2) == 0


class _Chunk:
    def __init__(self, docs: pa.Table, labels: pa.Table):
        self.doc = ids(docs["doc_id"])
        self.key = docs["text_key"].to_numpy()
        self.lang = docs["lang"]
        self.data, self.offsets = packed(docs["text"])
        self.trusted = np.isin(self.doc, ids(labels["doc_id"])) & (self.doc != NO_ID)
        train = self.trusted & _train_part(self.doc)
        first = np.zeros(len(self.doc), bool)
        if len(self.doc):
            first[pd.DataFrame({"d": self.doc, "k": self.key}).drop_duplicates().index] = True
        self.train = train & first
        self.held_out = self.trusted & ~train & first

    def blocks(self):
        """Some texts at a time: their rows, the gram at each byte as a place in the distinct
        grams, these, and the offsets of the texts."""
        for lo, hi in parts(np.diff(self.offsets), BYTES_AT_ONCE):
            value, at = grams(self.data[self.offsets[lo] : self.offsets[hi]], self.offsets[lo : hi + 1] - self.offsets[lo])
            codes, found = pd.factorize(value)
            yield np.arange(lo, hi), codes, found, at


def _count(key, docs: pa.Table, labels: pa.Table) -> pa.Table:
    """Grams of the training documents of a chunk."""
    total = []
    if docs.num_rows:
        chunk = _Chunk(docs, labels)
        for rows, codes, found, at in chunk.blocks():
            keep = np.repeat(chunk.train[rows], np.diff(at))
            n = np.bincount(codes[keep], minlength=len(found))
            total.append((found[n > 0], n[n > 0]))
    if not total:
        return pa.table({"gram": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    gram, n = (np.concatenate(x) for x in zip(*total))
    codes, found = pd.factorize(gram)
    return pa.table({"gram": found, "n": np.bincount(codes, weights=n).astype(np.int64)})


def _all_grams(chunk: _Chunk) -> np.ndarray:
    """Every gram of a chunk, of all orders, in one fixed order: order and bytes."""
    parts_ = [np.unique(found) for _, _, found, _ in chunk.blocks()]
    start = np.full(1, LOW)  # its shorter forms are the contexts at the start of a text
    longest = np.unique(np.concatenate([start, *parts_]))
    return np.concatenate([np.unique(shorter(longest, k)) | (k << 40) for k in range(ORDER + 1)])


def _planes(values: np.ndarray) -> bytes:
    """The bytes of sorted numbers, all first bytes, all second ones, and so on."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unplane(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(6, -1)
    wide = np.zeros((six.shape[1], 8), np.uint8)
    wide[:, :6] = six.T
    return wide.reshape(-1).view("<i8")


def _by_shard(grams_: np.ndarray, shards: int):
    shard = grams_ % PRIME % shards
    order = np.argsort(shard, kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=shards))
    return [(s, order[(ends[s - 1] if s else 0) : ends[s]]) for s in range(shards)]


def _ask(shards: int, key, docs: pa.Table, labels: pa.Table) -> pa.Table:
    rows = []
    if docs.num_rows:
        wanted = _all_grams(_Chunk(docs, labels))
        rows = [(s, _planes(wanted[at])) for s, at in _by_shard(wanted, shards) if len(at)]
    return pa.table(
        {
            "shard": pa.array([r[0] for r in rows], pa.int32()),
            "chunk": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "grams": pa.array([r[1] for r in rows], pa.binary()),
        }
    )


def _answer(key, asked: pa.Table, model: pa.Table) -> pa.Table:
    """For each request: the probability of each gram (0: never seen), and the logarithm of
    the weight that its context role gives to shorter grams (0 where it is no context)."""
    gram = model["gram"].to_numpy()
    order = np.argsort(gram)
    gram, chance, weight = gram[order], model["chance"].to_numpy()[order], model["weight"].to_numpy()[order]
    rows = []
    for row in asked.to_pylist():
        want = _unplane(row["grams"])
        at = np.minimum(np.searchsorted(gram, want), max(0, len(gram) - 1))
        hit = gram[at] == want if len(gram) else np.zeros(len(want), bool)
        c, w = (np.where(hit, v[at] if len(gram) else 0.0, 0.0).astype(np.float32) for v in (chance, weight))
        rows.append((row["chunk"], blob(c), blob(w[want >> 40 < ORDER])))
    return pa.table(
        {
            "chunk": pa.array([r[0] for r in rows], pa.int32()),
            "shard": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "chances": pa.array([r[1] for r in rows], pa.binary()),
            "weights": pa.array([r[2] for r in rows], pa.binary()),
        }
    )


def _score(shards: int, key, docs: pa.Table, notes: pa.Table) -> pa.Table:
    labels, answers = notes.filter(pc.is_valid(notes["doc_id"])), notes.filter(pc.is_null(notes["doc_id"]))
    chunk = _Chunk(docs, labels)
    cross, worst = np.full(len(chunk.doc), np.nan), np.full(len(chunk.doc), np.nan)
    if answers.num_rows and docs.num_rows:
        wanted = _all_grams(chunk)
        chance, weight = np.zeros(len(wanted), np.float32), np.zeros(len(wanted), np.float32)
        by = {a["shard"]: a for a in answers.to_pylist()}
        for s, at in _by_shard(wanted, shards):
            if len(at):
                chance[at] = np.frombuffer(by[s]["chances"], np.float32)
                weight[at[wanted[at] >> 40 < ORDER]] = np.frombuffer(by[s]["weights"], np.float32)
        logs = _back_off(wanted, chance.astype(np.float64), weight.astype(np.float64))
        longest = wanted[wanted >> 40 == ORDER] & LOW
        sums = np.zeros(len(chunk.doc))
        for rows, codes, found, at in chunk.blocks():
            value = logs[np.searchsorted(longest, found)][codes]
            sums[rows] = np.add.reduceat(value, at[:-1])  # every text has its end mark at least
            worst[rows] = worst_words(-value, chunk.data[chunk.offsets[rows[0]] : chunk.offsets[rows[-1] + 1]], at)
        cross = -sums
    return pa.table(
        {
            "doc_id": id_array(chunk.doc), "text_key": pa.array(chunk.key), "lang": chunk.lang,
            "n_bytes": pa.array(np.diff(chunk.offsets)), "trusted": pa.array(chunk.trusted), "held_out": pa.array(chunk.held_out),
            "cross": pa.array(cross, from_pandas=True), "worst": pa.array(worst, from_pandas=True),
        }
    )


def _back_off(wanted: np.ndarray, chance: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of each of the longest grams: that of the model where it
    saw the gram, else that of the gram without its first byte times its context's weight."""
    orders = wanted >> 40
    below, lower, weights = np.zeros(1, np.int64), np.full(1, 1 / BYTES), weight[orders == 0]
    for k in range(1, ORDER + 1):
        mine = orders == k
        gram = wanted[mine] & LOW
        context = weights[np.searchsorted(below, gram >> 8)]
        suffix = lower[np.searchsorted(below, shorter(gram, k - 1))]
        p = chance[mine]
        lower = np.where(p > 0, p, np.where(context > 0, context, 1.0) * suffix)
        below, weights = gram, weight[mine]
    return np.log(lower)


# --- the model ---


def _discounts(counts: dict[int, DataFrame]) -> dict[int, tuple[float, float, float]]:
    """Modified Kneser-Ney discounts of each order, from how many grams occur 1, 2, 3, 4 times."""
    every = None
    for k, table in counts.items():
        part = table.select(F.lit(k).alias("k"), "n")
        every = part if every is None else every.unionByName(part)
    times = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]
    out = dict.fromkeys(counts, (0.5, 1.0, 1.5))
    for row in every.groupBy("k").agg(*times).collect():  # one row an order
        n = [row[f"n{i}"] for i in range(1, 5)]
        if min(n) > 0:
            y = n[0] / (n[0] + 2 * n[1])
            found = (i + 1 - (i + 2) * y * n[i + 1] / n[i] for i in range(3))
            out[row["k"]] = tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))
    return out


def kneser_ney(counts: DataFrame) -> DataFrame:
    """gram (with its order), chance, weight: the model over counted ORDER-grams. The table of
    each order is written before the next one is made from it, which keeps plans small."""
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # in how many ways a shorter gram is preceded
        shorter_ = F.col("gram").bitwiseAND((1 << (8 * k)) - 1).alias("gram")
        tables[k] = store_table(tables[k + 1].groupBy(shorter_).agg(F.count("*").alias("n")), f"grams-{k}")
    discounts = _discounts(tables)
    lower = None
    rows = []
    for k in range(1, ORDER + 1):
        d = discounts[k]
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        prefix = F.shiftright("gram", 8)
        context = tables[k].groupBy(prefix.alias("prefix")).agg(F.sum("n").alias("total"), (F.sum(cut) / F.sum("n")).alias("weight"))
        context = store_table(context, f"contexts-{k}")
        mine = tables[k].withColumn("prefix", prefix).join(context, "prefix")
        if lower is None:
            mine = mine.withColumn("suffix_chance", F.lit(1 / BYTES))
        else:
            mine = mine.withColumn("suffix", F.col("gram").bitwiseAND((1 << (8 * (k - 1))) - 1)).join(lower, "suffix")
        share = F.greatest(F.col("n") - cut, F.lit(0.0)) / F.col("total")
        chances = mine.select("gram", (share + F.col("weight") * F.col("suffix_chance")).alias("chance"))
        chances = store_table(chances, f"chances-{k}")
        lower = chances.select(F.col("gram").alias("suffix"), F.col("chance").alias("suffix_chance"))
        rows.append(chances.select((F.col("gram") + (k << 40)).alias("gram"), "chance", F.lit(0.0).alias("weight")))
        rows.append(context.select((F.col("prefix") + ((k - 1) << 40)).alias("gram"), F.lit(0.0).alias("chance"), "weight"))
    model = rows[0]
    for more in rows[1:]:
        model = model.unionByName(more)
    return model.groupBy("gram").agg(F.sum("chance").alias("chance"), F.sum("weight").alias("weight"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids that every label row calls good and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    judged = labels.groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good"))
    return judged.filter("good").select(F.col("doc_id").cast("long").alias("doc_id"))


def cross_entropies(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each row the negative logarithm of its probability under the model, in SCORES."""
    chunks = shards = part_count(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        chunk_of(F.col("doc_id"), chunks).alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_key"), F.col("lang").cast("string").alias("lang"), text.alias("text"),
    )
    good = trusted_ids(labels).select(chunk_of(F.col("doc_id"), chunks).alias("chunk"), "doc_id")
    by_chunk = rows.groupBy("chunk")
    counted = by_chunk.cogroup(good.groupBy("chunk")).applyInArrow(freeing(_count), COUNTS)
    counts = store_table(counted.groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")
    model = kneser_ney(counts).withColumn("shard", (F.col("gram") % PRIME % shards).cast("int"))
    asked = by_chunk.cogroup(good.groupBy("chunk")).applyInArrow(freeing(partial(_ask, shards)), ASKED)
    answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(freeing(_answer), ANSWER)
    nothing = {"shard": "int", "chances": "binary", "weights": "binary"}
    notes = answers.withColumn("doc_id", F.lit(None).cast("long")).unionByName(
        good.select("chunk", "doc_id", *(F.lit(None).cast(t).alias(n) for n, t in nothing.items()))
    )
    return by_chunk.cogroup(notes.groupBy("chunk")).applyInArrow(freeing(partial(_score, shards)), SCORES)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_key, lang, n_bytes, perplexity (per byte), rejected of each row."""
    scores = store_table(cross_entropies(docs, labels), "perplexities")
    length = F.col("n_bytes") + 1

    def with_values(table: DataFrame, **values) -> DataFrame:
        """Add values over the held-out rows of each language, or over all of them where the
        language has too few; there is one row a language to join."""
        held_out = table.filter("held_out")
        named = [v.alias(n) for n, v in values.items()]
        every = held_out.agg(*named).first()
        own = held_out.groupBy(F.col("lang").alias("own_lang")).agg(F.count("*").alias("n"), *named).filter(F.col("n") >= FEW)
        joined = table.join(own, F.col("lang").eqNullSafe(F.col("own_lang")), "left")
        return joined.select(*table.columns, *(F.coalesce(n, F.lit(every[n]).cast("double")).alias(n) for n in values))

    scores = with_values(scores, mean=F.sum("cross") / F.sum(length))
    scores = scores.withColumn("nats", (F.col("cross") + PRIOR * F.col("mean")) / (length + PRIOR))
    judged = with_values(scores, limit=F.percentile_approx("nats", QUANTILE, 10000), word_limit=F.percentile_approx("worst", QUANTILE, 10000))
    outside = (F.col("nats") > F.col("limit") + MARGIN) | (F.col("worst") > F.col("word_limit") + WORD_MARGIN)
    return judged.select(
        "doc_id", "text_key", "lang", "n_bytes", F.exp("nats").alias("perplexity"),
        (F.coalesce(outside, F.lit(False)) & (F.col("n_bytes") > 0)).alias("rejected"),
    )
