import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from loglens.llm.periodic_runs import Grammar, periodic_runs, runs_of


def brute_runs(words):
    """Every period of every stretch, by comparing words."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        same = [a == b for a, b in zip(words, words[q:])] + [False]
        start = None
        for i, equal in enumerate(same):
            if equal and start is None:
                start = i
            if not equal and start is not None:
                end = i + q
                inner = words[start:end]
                smaller = any(inner[d:] == inner[: len(inner) - d] for d in range(1, q))
                if end - start >= max(6, 4 * q) and not smaller:
                    found.append((start, end, q))
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    out = []
    for _ in range(rng.randint(0, 5)):
        top = rng.randint(0, 3)
        if rng.random() < 0.6:
            unit = [rng.randint(0, top) for _ in range(rng.randint(1, 8))]
            out += (unit * 50)[: rng.randint(1, 45)]
        else:
            out += [rng.randint(0, top) for _ in range(rng.randint(0, 15))]
    return out


def as_arrays(texts):
    words = np.array([w for t in texts for w in t], np.int64)
    return words, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def test_runs_equal_brute_force():
    rng = random.Random(7)
    for _ in range(800):
        texts = [random_words(rng) for _ in range(rng.randint(1, 4))]
        got = list(zip(*(x.tolist() for x in runs_of(*as_arrays(texts)))))
        want, offset = [], 0
        for t in texts:
            want += [(s + offset, e + offset, q) for s, e, q in brute_runs(t)]
            offset += len(t)
        assert got == want, texts


def test_grammar_gives_the_texts_back():
    """Every place of a rule holds the words of its first occurrence, and no pair of the start string repeats."""
    rng = random.Random(8)
    for _ in range(100):
        texts = [random_words(rng) for _ in range(3)]
        words, text = as_arrays(texts)
        if not len(words):
            continue
        g = Grammar(words, text)
        covered = 0
        for r in range(len(g.lo)):
            whole = words[g.lo[r] : g.hi[r]].tolist()
            places = g.places[g.first[r] : g.first[r + 1] if r + 1 < len(g.lo) else None].tolist()
            covered += len(places)
            for p in places:
                assert words[p : p + len(whole)].tolist() == whole
                assert text[p] == text[p + len(whole) - 1] == text[g.lo[r]]
            assert g.lo[r] < g.mid[r] < g.hi[r]
        assert covered + len(g.ends) == len(words)  # each replacement takes one symbol


def test_long_periods():
    rng = random.Random(9)
    unit = [rng.randint(0, 10**6) for _ in range(3000)]
    words = [1, 2, 3] + (unit * 5)[:13000] + [5] * 40000 + [rng.randint(0, 10**6) for _ in range(5000)]
    got = list(zip(*(x.tolist() for x in runs_of(*as_arrays([words])))))
    assert (3, 13003, 3000) in got and (13003, 53003, 1) in got and len(got) == 2


def expected(doc_id, text, tails):
    words = [w for w in (text or "").encode().split()]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if tails and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2])) if runs else None
    shown = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    digests = (
        "".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode(),
        b" ".join(w for i, w in enumerate(words) if i not in gone),
    )
    return (doc_id, len(runs), *shown, *(hashlib.sha256(x).hexdigest() for x in digests))


def test_odd_rows(spark):
    rows = [(1, "a b " * 9), (1, "a b " * 9), (2, None), (3, ""), (None, "x " * 6), (4, " \t\n"), (5, "\x0b".join("pqr" * 30)), (6, "é\xa0é é\xa0é " * 20)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id int, text string, start int, period int")
    got = sorted(map(tuple, periodic_runs(df).collect()), key=str)
    assert got == sorted((expected(d, t, False) for d, t in rows), key=str)
    assert periodic_runs(df.limit(0)).collect() == []


def test_query_on_documents(spark):
    from loglens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 12000]
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    assert sum(1 for r in got.values() if r[1]) > 5
    for doc_id, text in docs:
        assert got[doc_id] == expected(doc_id, text, True)
