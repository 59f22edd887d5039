"""Exact top-k inner products by aggregation without random access.

In each block of candidates every dimension has a list sorted by value; a query reads it
from its best end (largest values for a positive weight, smallest for a negative one).
Reading goes in growing strides over all lists at once. For every candidate a lower and
an upper bound of its score are kept: the part read, plus the worst and the best that
its unread components can be. When few enough outsiders have an upper bound that reaches
the k-th lower bound, reading stops and the final scores of those left are resolved;
all others cannot qualify. A list read to its end gives the score itself.

Blocks of queries meet blocks of candidates by an equi-join on the pair of blocks; each
pair gives at most k rows a query, and ranks are cut to k before and after the shuffle.

Scores are exact for all finite components. Vectors whose products may pass the whole numbers
that a double holds are bounded in the same way, by rounded products and the most that rounding
can change, and those able to qualify are resolved in whole numbers of any length.

Results for odd input: vectors that are null or hold null or non-finite components (also
after multiplying by 64) take no part; a score beyond a long is null, its rank is exact; shorter vectors count as filled up with zeros; rows that repeat vec_id and vector
count once; no row of the query's own vec_id is its candidate; a null vec_id is no query
and comes before other ids in ties; fewer candidates give fewer rows; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import blob, id_array, ids

K = 20
EVERY = 20
SCALE = 64
CANDIDATE_BLOCK = 2048
QUERY_BLOCK = 4096
QUERIES_AT_ONCE = 512
STRIDES = (0.1, 0.3, 1.0)
FEW = 0.02  # share of the block that may be left when reading stops
BLOCK = "block int, dims int, ids binary, vectors binary"
FOUND = "query_id long, query_key long, vec_id long, score long, side int, beyond binary"
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]
LARGEST_LONG = (1 << 63) - 1
BEYOND_BYTES = 320  # holds every sum of products of two finite doubles


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id and 64 x of each component, of the rows that take part; blocks hold the floors."""
    scaled = F.lit(float(SCALE))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled * x.cast("double")) < F.lit(float("inf"))))
    return embeddings.filter(F.col("embedding").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: scaled * x.cast("double")).alias("vector"),
    )


def _pack_block(key, table):
    vec, rows = ids(table["vec_id"]), table["vector"].to_pylist()
    dims = max(map(len, rows), default=0)
    x = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    x = np.floor(x) + 0.0  # one zero only; a double holds the floor of any double
    full = np.unique(np.column_stack([vec, x.view(np.int64)]), axis=0)  # in order of id; repeats once
    return pa.table(
        {
            "block": pa.array([key[0].as_py()], pa.int32()),
            "dims": pa.array([dims], pa.int32()),
            "ids": pa.array([blob(full[:, 0])], pa.binary()),
            "vectors": pa.array([blob(full[:, 1:])], pa.binary()),
        }
    )


def _blocks(rows: DataFrame, count: int) -> DataFrame:
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))
    return dealt.groupBy("block").applyInArrow(_pack_block, BLOCK)


class SortedLists:
    """The sorted lists of a block of candidates."""

    def __init__(self, x: np.ndarray):
        self.x = x
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, 0)  # ascending
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(x))[:, None], 0)

    def bounds(self, depth: int):
        """Values to use for each candidate and dimension after reading ``depth`` entries from
        the best end: (positive weights: lower, upper), (negative weights: lower, upper)."""
        n = len(self.x)
        if depth >= n:
            return (self.x, self.x), (self.x, self.x)
        lowest, highest = self.sorted[0], self.sorted[-1]
        top = self.rank >= n - depth
        bottom = self.rank < depth
        next_top, next_bottom = self.sorted[n - depth - 1], self.sorted[depth]
        return (
            (np.where(top, self.x, lowest), np.where(top, self.x, next_top)),
            (np.where(bottom, self.x, highest), np.where(bottom, self.x, next_bottom)),
        )


def nra_top(queries: np.ndarray, own: np.ndarray, lists: SortedLists, k: int):
    """(query, candidate, score) of the k best of each query; candidates are in order of id.

    ``own`` is True where a candidate is no candidate of the query.
    """
    n = len(lists.x)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    todo = np.arange(len(queries))
    out = []
    for stride in STRIDES:
        depth = n if stride >= 1 else max(1, int(stride * n))
        (low_p, high_p), (low_m, high_m) = lists.bounds(depth)
        if depth >= n:
            out.append(_ranked(todo, queries[todo] @ lists.x.T, ~own[todo], k))
            break
        lower = plus[todo] @ low_p.T + minus[todo] @ low_m.T
        upper = plus[todo] @ high_p.T + minus[todo] @ high_m.T
        lower[own[todo]] = -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(todo), -np.inf)
        able = (upper >= kth[:, None]) & ~own[todo]
        stop = able.sum(1) <= max(k, FEW * n)
        for i in np.flatnonzero(stop):  # resolve the few that are left
            rows = np.flatnonzero(able[i])
            scores = np.full((1, n), -np.inf)
            scores[0, rows] = lists.x[rows] @ queries[todo[i]]
            out.append(_ranked(todo[i : i + 1], scores, able[i : i + 1], k))
        todo = todo[~stop]
        if not len(todo):
            break
    return tuple(np.concatenate(x) for x in zip(*out))


def _ranked(query: np.ndarray, scores: np.ndarray, able: np.ndarray, k: int):
    """The k highest of each row, ties to the candidate that comes first."""
    scores = np.where(able, scores, -np.inf)
    n = scores.shape[1]
    if n > k:
        kth = np.partition(scores, n - k, axis=1)[:, n - k]
        tie = (scores == kth[:, None]) & able
        room = k - ((scores > kth[:, None]) & able).sum(1)
        able = able & ((scores > kth[:, None]) | (tie & (np.cumsum(tie, 1) <= room[:, None])))
    i, j = np.nonzero(able)
    return query[i], j, scores[i, j].astype(np.int64)


def resolved_top(queries: np.ndarray, own: np.ndarray, x: np.ndarray, k: int):
    """(query, candidate, whole score) of the k best of each query, whatever the size of the
    components: rounded scores give bounds, those able to qualify are resolved."""
    n, dims = x.shape
    whole: dict[int, list[int]] = {}  # candidates as whole numbers
    with np.errstate(over="ignore", invalid="ignore"):
        near = queries @ x.T
        room = (np.abs(queries) @ np.abs(x).T) * ((dims + 2) * 2.0**-51)
        lower, upper = near - room, near + room
    blind = ~(np.isfinite(lower) & np.isfinite(upper))  # no bounds: always able
    lower[own | blind] = -np.inf
    upper[blind] = np.inf
    kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(queries), -np.inf)
    able = (upper >= kth[:, None]) & ~own
    for i, query in enumerate(queries):
        q = [int(v) for v in query]
        scores = []
        for j in np.flatnonzero(able[i]).tolist():
            if j not in whole:
                whole[j] = [int(v) for v in x[j]]
            scores.append((-sum(a * b for a, b in zip(q, whole[j])), j))
        for score, j in heapq.nsmallest(k, scores):
            yield i, j, -score


def _found(q_ids, keys, c_ids, who, what, scores) -> pa.RecordBatch:
    """Rows of whole scores; those beyond a long are told by their side and their bytes."""
    side = [(s > LARGEST_LONG) - (s < -LARGEST_LONG - 1) for s in scores]
    columns = [
        pa.array(q_ids[who]),
        pa.array(keys[who]),
        id_array(c_ids[what]),
        pa.array([None if b else s for s, b in zip(scores, side)], pa.int64()),
        pa.array(side, pa.int32()),
        pa.array([(s + (1 << 8 * BEYOND_BYTES - 1)).to_bytes(BEYOND_BYTES, "big") if b else None for s, b in zip(scores, side)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, FOUND_NAMES)


def _search(k: int, batches):
    for batch in batches:
        for row in batch.to_pylist():
            q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
            dims = max(row["q_dims"], row["c_dims"], 1)
            q, c = (np.zeros((len(i), dims)) for i in (q_ids, c_ids))
            q[:, : row["q_dims"]] = np.frombuffer(row["q_vectors"], np.float64).reshape(len(q_ids), -1)
            c[:, : row["c_dims"]] = np.frombuffer(row["c_vectors"], np.float64).reshape(len(c_ids), -1)
            keys = _vector_keys(q)
            # Products of rows up to this size stay exact in a double.
            usual = math.isqrt(((1 << 53) - 1) // dims)
            q_usual, c_usual = (np.abs(x).max(axis=1, initial=0) <= usual for x in (q, c))
            qs, cs = np.flatnonzero(q_usual), np.flatnonzero(c_usual)
            if len(qs) and len(cs):
                largest = max(np.abs(q[qs]).max(initial=0), 1) * max(np.abs(c[cs]).max(initial=0), 1) * dims
                kind = np.float32 if largest < 1 << 24 else np.float64  # whole numbers stay exact
                lists = SortedLists(c[cs].astype(kind))
                for lo in range(0, len(qs), QUERIES_AT_ONCE):
                    part = qs[lo : lo + QUERIES_AT_ONCE]
                    own = q_ids[part, None] == c_ids[None, cs]
                    who, what, score = nra_top(q[part].astype(kind), own, lists, k)
                    columns = [pa.array(q_ids[part][who]), pa.array(keys[part][who]), id_array(c_ids[cs][what]), pa.array(score)]
                    columns += [pa.array(np.zeros(len(who), np.int32)), pa.nulls(len(who), pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, FOUND_NAMES)
            for some, those in ((np.arange(len(q)), np.flatnonzero(~c_usual)), (np.flatnonzero(~q_usual), cs)):
                for lo in range(0, len(some) if len(those) else 0, QUERIES_AT_ONCE):
                    part = some[lo : lo + QUERIES_AT_ONCE]
                    own = q_ids[part, None] == c_ids[None, those]
                    best = list(resolved_top(q[part], own, c[those], k))
                    if best:
                        who, what, scores = zip(*best)
                        yield _found(q_ids[part], keys[part], c_ids[those], np.array(who), np.array(what), scores)


def _vector_keys(q: np.ndarray) -> np.ndarray:
    """A hash of the vector, to tell apart query rows that share a vec_id."""
    factors = (np.arange(q.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (np.ascontiguousarray(q).view(np.uint64) * factors).sum(1, dtype=np.uint64).astype(np.int64)


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, the
    k rows of highest score; ties go to the smaller vec_id."""
    rows = quantised(embeddings)
    total = embeddings.count()
    n_c = max(1, -(-total // CANDIDATE_BLOCK))
    n_q = max(1, -(-total // (every * QUERY_BLOCK)))
    candidates = _blocks(rows, n_c).select(F.col("block").alias("c"), *(F.col(x).alias(f"c_{x}") for x in ("dims", "ids", "vectors")))
    queries = _blocks(rows.filter(F.col("vec_id") % every == 0), n_q).select(
        F.col("block").alias("q"), *(F.col(x).alias(f"q_{x}") for x in ("dims", "ids", "vectors"))
    )
    # The query set meets all rows in pairs of blocks.
    candidates = candidates.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    queries = queries.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    pairs = candidates.join(queries, ["c", "q"]).select("q_dims", "q_ids", "q_vectors", "c_dims", "c_ids", "c_vectors")
    found = pairs.mapInArrow(partial(_search, k), FOUND)
    best = Window.partitionBy("query_id", "query_key").orderBy(
        F.col("side").desc(), F.col("score").desc(), F.col("beyond").desc(), F.col("vec_id").asc_nulls_first()
    )
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
