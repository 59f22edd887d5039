import hashlib
import random

import numpy as np
import pytest

from loglens.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, length=100):
    """The contract by a dictionary of strings, place by place."""
    first, out = {}, []
    docs = sorted({(d, t or "") for d, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    for n, (_, text) in enumerate(docs):
        data = text.encode()
        for p in range(len(data) - length + 1):
            first.setdefault(data[p : p + length], (n, p))
    result = {}
    for n, (d, text) in enumerate(docs):
        data = text.encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] != (n, p):
                gone[p : p + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        result[d, text] = (d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted((result[d, t or ""] for d, t in rows), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, None, "s", 1) for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in sd.suffix_dedup(df).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(n) for n in (20, 40, 60, 200)] + ["ab" * 200, "x" * 350]
    rows = []
    for d in range(60):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), text(rng.randint(0, 30))]
        rows.append((d, rng.choice(["", " "]).join(parts)))
    rows += [(100 + i, rows[i % 7][1]) for i in range(20)]
    for i in range(20):
        t = list(rows[i][1])
        for _ in range(3):
            if t:
                t[rng.randrange(len(t))] = "#"
        rows.append((200 + i, "".join(t)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [512, 2])
def test_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT_ANCHOR", hot)
    rows = corpus(hot)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(400))
    rows = [(1, None), (2, ""), (3, long), (3, long), (3, long + "x"), (None, long[:150]), (4, "é" * 60), (5, "é" * 60), (-7, long[50:])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_text_left(spark):
    rows = [(1, "a" * 30 + "é" * 80), (2, "é" * 80 + "b")]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    left = {r.doc_id: r.kept_text for r in sd.suffix_dedup(df, texts=True).collect()}
    assert left[2] == "b"


def test_deep_shallow_sorts():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 3000).astype(np.uint8)
    data[1000:1300] = data[500:800]
    start = np.arange(0, 2900)
    order, label = sd.deep_shallow(data, start, 100)
    texts = [data[s : s + 100].tobytes() for s in start]
    assert [texts[i] for i in order] == sorted(texts)
    for a, b, x, y in zip(order, order[1:], label, label[1:]):
        assert (texts[a] == texts[b]) == (x == y)
