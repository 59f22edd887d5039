import math
import random
from collections import Counter

import numpy as np
import pytest

from loglens.llm import classifier as qc

DOCS = "doc_id long, text string, lang string, quality string"
LABELS = "doc_id long, quality int, toxic int"


def brute_model(texts, order=5):
    """Interpolated modified Kneser-Ney by its definition, over dictionaries."""
    grams = Counter()
    for t in texts:
        seq = [255] * (order - 1) + list(t.encode()) + [0]
        for i in range(order - 1, len(seq)):
            grams[tuple(seq[i - order + 1 : i + 1])] += 1
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, totals, weights = {}, {}, {}
    for k in counts:
        n = [sum(v == i for v in counts[k].values()) for i in range(1, 5)]
        d = (0.5, 1.0, 1.5)
        if min(n) > 0:
            y = n[0] / (n[0] + 2 * n[1])
            d = tuple(min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3))
        cuts[k] = lambda v, d=d: d[min(v, 3) - 1]
        totals[k], weights[k] = Counter(), Counter()
        for g, v in counts[k].items():
            totals[k][g[:-1]] += v
            weights[k][g[:-1]] += cuts[k](v)

    def chance(g):
        if not g:
            return 1 / 257
        k, total = len(g), totals[len(g)][g[:-1]]
        if not total:
            return chance(g[1:])
        v = counts[k][g]
        return (max(v - cuts[k](v), 0) if v else 0) / total + weights[k][g[:-1]] / total * chance(g[1:])

    def cross(t):
        seq = [255] * (order - 1) + list(t.encode()) + [0]
        return -sum(math.log(chance(tuple(seq[i - order + 1 : i + 1]))) for i in range(order - 1, len(seq)))

    return cross, chance


def corpus(n, seed=1):
    rng = random.Random(seed)
    syllables = {"en": ["th", "er", "on", "an", "re", "he"], "fr": ["é", "eau", "ou", "tre", "en"]}
    good, bad = [], []
    for d in range(n):
        lang = rng.choice(["en", "fr"])
        words = ["".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(20, 90))]
        if d % 5 == 4:
            bad.append((d, " ".join(w.upper() + rng.choice(["!!", "$$$"]) for w in words), lang, "x"))
        else:
            good.append((d, " ".join(words), lang, "x"))
    return good, bad


@pytest.fixture(scope="module")
def tables(spark):
    good, bad = corpus(600)
    rows = good + bad + [(1000, None, "en", "x"), (1001, "", None, "x"), (1002, "zz" * 30, None, "x"), (None, "then", "en", "x"), good[0]]
    labels = [(r[0], 1, 0) for r in good[: len(good) // 2]] + [(r[0], 0, 0) for r in bad[:20]]
    labels += [(good[3][0], 0, 0), (good[4][0], 1, 1), (None, 1, 0), (good[5][0], None, None)]
    return rows, labels, spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


def test_against_the_definition(tables):
    rows, labels, docs, marks = tables
    bad_ids = {d for d, q, t in labels if not (q == 1 and not t)}
    trusted = {d for d, _, _ in labels if d is not None} - bad_ids
    train = {(d, t) for d, t, *_ in rows if d in trusted and qc._train_part(np.array([d]))[0]}
    assert 20 < len(train) < len(trusted)
    cross, chance = brute_model([t for _, t in train])
    got = qc.cross_entropies(docs, marks).collect()
    assert len(got) == len(rows)
    text = {(d, t or ""): t or "" for d, t, *_ in rows}
    want = {d: cross(t) for (d, _), t in text.items()}
    for r in got:
        assert r.cross == pytest.approx(want[r.doc_id], rel=1e-4, abs=1e-3)
        assert r.trusted == (r.doc_id in trusted)
    for context in [(255,) * 4, tuple(b"then"), tuple(b"zqzq")]:
        assert sum(chance(context + (c,)) for c in range(256)) <= 1.0001


def test_held_out_accuracy(tables):
    rows, labels, docs, marks = tables
    kind = {d: " ".join(t or "").isupper() or "!!" in (t or "") or "$$$" in (t or "") for d, t, *_ in rows}
    seen = {d for d, *_ in labels}
    judged = [r for r in qc.classify(docs, marks).collect() if r.doc_id is not None and r.doc_id < 600 and r.doc_id not in seen]
    assert len(judged) > 150
    assert all(r.rejected == kind[r.doc_id] for r in judged)


def test_one_word_that_stands_out(spark):
    good, _ = corpus(600)
    half = len(good) // 2
    spoilt = [(2000 + d, t + " zwkqj " + t, lang, x) for d, t, lang, x in good[half : half + 60]]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good[:half]], LABELS)
    got = {r.doc_id: r.rejected for r in qc.classify(spark.createDataFrame(good + spoilt, DOCS), labels).collect()}
    assert all(got[r[0]] for r in spoilt) and not any(got[r[0]] for r in good[half:])


def test_odd_rows(tables, spark):
    rows, labels, docs, marks = tables
    by = {}
    for r in qc.classify(docs, marks).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert not by[1000][0].rejected and not by[1001][0].rejected and by[1002][0].rejected
    assert len(by[rows[0][0]]) == 2 and len(set(by[rows[0][0]])) == 1
    nobody = qc.classify(docs, marks.limit(0)).collect()
    assert len(nobody) == len(rows) and not any(r.rejected for r in nobody)
    assert qc.classify(docs.limit(0), marks).collect() == []
