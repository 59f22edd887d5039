import random
import re
from collections import Counter

import pytest

from loglens.llm.collocations import collocations, compacted, long_phrases, phrase_counts, split_words

SCHEMA = "doc_id long, text string, lang string, words int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, 1, 2) for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


def pieces(text):
    for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
        yield re.findall("[^\x20\x09]+", piece)


def counts(rows, longest=5):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return f, n


def expected(rows, least, top):
    f, n = counts(rows)
    out = []
    often = {key: c for key, c in f.items() if c >= least}
    for (lang, words), a in often.items():
        if len(words) < 2:
            continue
        holders = (c for (other, w), c in often.items() if other == lang and len(w) > len(words) and _inside(words, w))
        if any(100 * c >= 100 * a for c in holders):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    out.sort()
    ranked, seen = [], Counter()
    for lang, score, a, phrase, l, r in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return ranked


def _inside(short, long):
    return any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    names = ["the", "of", "New", "new", "york", "times", "a", "b c", "É", "é", "x_y"]
    passage = "we the people of new york do hereby read the times again"
    out = []
    for _ in range(120):
        words = [rng.choice(names) for _ in range(rng.randint(0, 30))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!"]) for w in words)
        if rng.random() < 0.3:
            text += " " + passage
        out.append((text, rng.choice(["en", "en", "de", None])))
    return out + [(None, "en"), ("", None), (" \t.,", "fr"), ("lone", "fr"), ("q", None)] + [("same text here again", "de")] * 30


def test_split():
    words = [w.decode() if w != b"\xff" else "|" for w in split_words("A b C,\x1cd.\x0b\x85E")]
    assert words == ["a b", "c", "|", "\x1cd", "|", "|", "\x85e", "|"]


def test_equals_brute_force(spark, rows):
    got = collocations(frame(spark, rows), min_count=8, top=25).collect()
    assert sorted(map(tuple, got)) == sorted(expected(rows, 8, 25))
    assert got[0].asDict().keys() == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}


def test_counts_from_the_graph(spark, rows):
    phrases, words, totals = phrase_counts(frame(spark, rows), 8)
    name = {r.id: (r.label, r.word) for r in words.collect()}
    got = {(name[r.words[0]][0], tuple(name[i][1] for i in r.words)): r.n for r in phrases.collect()}
    f, n = counts(rows)
    assert got == {key: c for key, c in f.items() if c >= 8}
    assert {r.label: r.total for r in totals.collect()} == {lang: c for lang, c in n.items() if c}


def test_paths_give_passages(spark, rows):
    phrases, words, _ = phrase_counts(frame(spark, rows), 8)
    name = {r.id: (r.label, r.word) for r in words.collect()}
    f, _ = counts(rows, 14)
    paths = [(name[r.words[0]][0], tuple(name[i][1] for i in r.words), r.n) for r in long_phrases(phrases).collect()]
    assert any("people of new york do hereby read the times again" in " ".join(w) for _, w, _ in paths)
    for lang, path, n in paths:
        assert f[lang, path] <= n
        assert all(f[lang, path[i : i + 5]] == n for i in range(len(path) - 4))
    edges = [tuple(w[i : i + 5]) + (lang,) for lang, w, _ in paths for i in range(len(w) - 4)]
    assert sorted(edges) == sorted(w + (lang,) for (lang, w), c in f.items() if c >= 8 and len(w) == 5)
    assert compacted(phrases).count() > 0


def test_large_numbers_and_empty(spark):
    df = frame(spark, [("p q", "en")] * 400)
    got = collocations(df, min_count=100).collect()
    assert [tuple(r) for r in got] == [("en", 1, "p q", 400, 400, 400, 800, 1000 * 400 * 800 // (400 * 400))]
    assert collocations(df.limit(0)).collect() == []


def test_phrases_are_never_broadcast(spark, rows):
    """A stored table of phrases is small as a file and large as rows: only the totals of the
    languages go whole through the driver."""
    got = collocations(frame(spark, rows), min_count=8, top=25)
    modes = re.findall(r"HashedRelationBroadcastMode\(List\((.*?)\),", got._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, got.collect())) == sorted(expected(rows, 8, 25))
    modes += re.findall(r"HashedRelationBroadcastMode\(List\((.*?)\),", got._jdf.queryExecution().executedPlan().toString())
    assert modes and all("string" in x for x in modes), modes
