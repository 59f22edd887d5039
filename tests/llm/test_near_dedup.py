import math
import random
from collections import Counter

import numpy as np
import pytest

from loglens.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, class_id int"


def brute(rows):
    """Classes by comparing all texts, and the similarity of all pairs."""
    texts = sorted({t or "" for _, t in rows})
    bags = {}
    for t in texts:
        w = t.encode().split()
        bags[t] = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    df = Counter(s for b in bags.values() for s in b)
    n = len(rows)
    weigh = {t: {s: c * (1 + nd.IDF_SPAN * math.log(n / min(df[s], n)) / math.log(max(n, 2))) for s, c in b.items()} for t, b in bags.items()}
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    sims = {}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            x, y = weigh[a], weigh[b]
            common = sum(min(x[s], y[s]) for s in x.keys() & y.keys())
            union = sum(x.values()) + sum(y.values()) - common
            if common:
                sims[a, b] = common / union
                if common / union >= nd.SIMILARITY:
                    parent[root(a)] = root(b)
    groups = {}
    for d, t in rows:
        groups.setdefault(root(t or ""), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return sorted(((d, least[root(t or "")]) for d, t in rows), key=str), sims


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.class_id) for r in nd.near_classes(df).collect()), key=str)


def corpus(seed, families=25):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéf", k=rng.randint(2, 7))) for _ in range(400)]
    passage = rng.choices(words, k=30)
    texts = []
    for _ in range(families):
        base = rng.choices(words, k=rng.randint(3, 160))
        if rng.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        texts.append(base)
        for _ in range(rng.choice([0, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    rows = [(d, rng.choice([" ", "\n"]).join(t)) for d, t in enumerate(texts)]
    rows += [(500 + i, rows[i][1]) for i in range(0, len(rows), 5)]
    rows += [(600, None), (601, ""), (602, "a b c d"), (603, "a b c d"), (None, rows[3][1]), (7, rows[7][1]), (7, rows[8][1]), (604, "x " * 3000)]
    rng.shuffle(rows)
    return rows


def test_classes(spark):
    rows = corpus(1)
    want, sims = brute(rows)
    assert min(abs(s - nd.SIMILARITY) for s in sims.values()) > 1e-4
    assert run(spark, rows) == want
    assert len({c for _, c in want}) < len(want) - 10
    assert run(spark, []) == []


def test_a_large_family(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = []
    for d in range(150):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{d}"
        rows.append((d, " ".join(copy)))
    rows.append((999, " ".join(f"y{i}" for i in range(200))))
    assert {c for d, c in run(spark, rows) if d != 999} == {0}


def test_pairs_inside_a_family_under_the_limit(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]

    def changed(words, n):
        copy = list(words)
        for i in rng.sample(range(2, 198), n):
            copy[i] = f"x{rng.randrange(10**9)}"
        return copy

    family = [changed(base, 3) for _ in range(200)]
    family += [changed(family[i], 3) for i in range(60)]  # pairs over the limit
    rows = [(d, " ".join(t)) for d, t in enumerate(family)]
    want, sims = brute(rows)
    assert 30 < sum(s >= nd.SIMILARITY for s in sims.values()) < 2000 and len({c for _, c in want}) > 100
    assert run(spark, rows) == want


def test_chains_are_merged(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 105), (103, 105)]
    key = lambda i: bytearray(i.to_bytes(2, "big"))
    links = spark.createDataFrame([(key(b), key(a)) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.label, "big") for r in nd.merge(links, "chain").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 103, 105)}}


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(2)
    window = np.sort(rng.integers(0, 1 << 63, 600).astype(np.uint64))
    a = rng.random(600) + 0.5
    b = np.where(rng.random(600) < 0.8, a, a * 0.3)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    begin = np.zeros(1, np.int64)
    agree = (nd.samples(window, a, begin) == nd.samples(window, b, begin)).mean()
    assert agree == pytest.approx(want, abs=0.12)
    assert (nd.samples(window, a, begin) == nd.samples(window, a, begin)).all()
