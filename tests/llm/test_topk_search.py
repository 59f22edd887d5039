import math
import random

import numpy as np
import pytest

from loglens.llm import topk_search as ts

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, k=20, every=20):
    fine = {}
    for vec_id, e in rows:
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            fine[vec_id, tuple(math.floor(64 * float(np.float32(x))) for x in e)] = None
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for q, a in fine:
        if q is not None and q % every == 0:
            scores = [(-dot(a, b), c is not None, c or 0, c) for c, b in fine if c != q]
            out += [(q, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def corpus(n, dims, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.15) for _ in range(dims)]) for i in range(n)]
    same = rows[3][1]
    rows += [(n + i, same) for i in range(60)]  # ties
    rows += [(None, same), (1000, None), (1020, [None] * dims), (1040, [float("nan")] * dims), (1060, [float("inf")] + [0.0] * (dims - 1))]
    return rows + [(2000, []), (2020, [0.5]), rows[5], rows[20], (20, [0.25] * dims)]


@pytest.mark.parametrize("block", [64, 2048])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ts, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(ts, "QUERY_BLOCK", 8)
    rows = corpus(300, 6, block)
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA)
    assert sorted((tuple(r) for r in ts.top_k(df).collect()), key=str) == brute(rows)
    assert ts.top_k(df.limit(0)).collect() == []
    few = df.filter("vec_id < 5")
    assert sorted((tuple(r) for r in ts.top_k(few).collect()), key=str) == brute(rows[:5])


@pytest.mark.parametrize("kind, sizes", [("float", (1e9, 3e38)), ("double", (1e9, 1e17, 1e150, 2.5e306, 1e308))])
def test_components_of_any_size(spark, kind, sizes):
    """Scores beyond a double's whole numbers, beyond a long and beyond any double."""
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, rng.choice((0.2, *sizes))) for _ in range(4)]) for i in range(90)]
    rows += [(90 + i, [rng.gauss(0, 0.2) for _ in range(4)]) for i in range(60)]
    rows += [(200 + i, rows[i % 7][1]) for i in range(40)]  # ties
    rows += [(300 + i, [s, -s, s, -s + j]) for s in sizes for i, j in ((0, 1), (1, 0), (20, 2))]  # near ties
    rows = [(i, [x if kind == "double" or abs(x) < 3.4e38 else 3e38 for x in e]) for i, e in rows]
    if kind == "float":
        rows = [(i, [float(np.float32(x)) for x in e]) for i, e in rows]
    exact = {}
    for i, e in rows:
        if all(math.isfinite(64 * x) for x in e):
            exact[i, tuple(math.floor(64 * x) for x in e)] = None
    want = []
    for q, a in exact:
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in exact if c != q)[:20]
            want += [(q, r + 1, c, -s if -(1 << 63) <= -s < 1 << 63 else None) for r, (s, c) in enumerate(scores)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in ts.top_k(df).collect()), key=str)
    assert got == sorted(want, key=str)


def test_reading_stops_early():
    """A few strong candidates settle the result before the lists are read to their ends."""
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (1000, 8)).astype(np.float32)
    x[:30] += 50
    lists = ts.SortedLists(x)
    read = []
    bounds = lists.bounds
    lists.bounds = lambda depth: read.append(depth) or bounds(depth)
    q = np.abs(rng.integers(1, 5, (3, 8))).astype(np.float32)
    who, what, score = ts.nra_top(q, np.zeros((3, 1000), bool), lists, 20)
    assert max(read) < 1000 and len(who) == 60
    want = np.sort(q @ x.T, axis=1)[:, -20:]
    for i in range(3):
        assert sorted(score[who == i]) == want[i].tolist()


def test_sql(spark):
    from checks.verify import check_engine, compare
    from loglens.llm.queries import ORACLE, QUERIES

    sf = "/root/testdata/sf0.001"
    assert compare(spark, check_engine(sf), "op5", QUERIES["op5_top_k"], ORACLE["op5_top_k"], sf) == ""
