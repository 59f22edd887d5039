import random
import re

import numpy as np

from loglens.llm import quality_rules as qr
from loglens.llm.common import word_hashes, windows_of

SCHEMA = "doc_id long, text string, kept int"
BLANKS = "\x20\x09-\x0d"


def brute(doc_id, text):
    text = text or ""
    words = re.findall(f"[^{BLANKS}]+", text)
    lines = [x for x in text.split("\n") if re.search(f"[^{BLANKS}]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    chars = sum(map(len, words))
    again = len(lines) - len(set(lines))
    capital, small = len(re.findall("[A-ZÀ-ÖØ-Þ]", text)), len(re.findall("[a-zß-öø-ÿ]", text))
    bare = sum(not re.search(r"[A-Za-z]|[^\x00-\x7f]", w) for w in words)
    bad = [
        10 * symbols > len(words), not 2 * len(words) <= chars <= 14 * len(words), 10 * again > 3 * len(lines),
        capital > small, 10 * bare > 3 * len(words), 2 * text.count("!") > len(words),
    ]
    return (doc_id, len(words), chars, symbols, again, len(covered), failed, not failed and not any(bad))


def corpus():
    rng = random.Random(2)
    words = ["tion", "the", "of", "Été", "naïve", "x", "日本", "re-do", "don't", "\x1cq", "w" * 80]
    kinds = [
        lambda w: w, lambda w: w + "$$$", lambda w: w.upper(), lambda w: w + "!!", lambda w: w + " |", lambda w: "12",
        lambda w: "".join(rng.choice("abcdefghij") for _ in range(6)), lambda w: w * 9,
    ]
    rows = [(0, None), (1, ""), (2, " \n\t\r\x0b\x0c "), (3, "one"), (4, "a b c a b c"), (None, "same words again " * 30)]
    for d in range(5, 120):
        kind = rng.choice(kinds)
        own = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
        text = rng.choice([" ", "\n", "  "]).join(kind(rng.choice([rng.choice(words), own(), own()])) for _ in range(rng.randint(0, 150)))
        rows.append((d, "\n".join([text] + rng.choices(text.split(" ")[:9] + ["again"], k=rng.randint(0, 12)))))
    return rows + rows[20:25]


def test_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in qr.quality_rules(df).collect()), key=str)
    want = sorted((brute(d, t) for d, t in rows), key=str)
    assert got == want
    assert {r[-1] for r in want} == {True, False}
    assert qr.quality_rules(df.limit(0)).collect() == []


def test_order_does_not_change_the_verdict(spark):
    df = spark.createDataFrame([(d, t, 1) for d, t in corpus()], SCHEMA)
    a = qr.quality_rules(df, qr.RULES).collect()
    b = qr.quality_rules(df, qr.RULES[::-1]).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_cheap_and_selective_rules_come_first(spark):
    def slow(t):
        for _ in range(200):
            _ = np.sort(t.data)
        return np.zeros(len(t.n_words), bool)

    rules = (qr.Rule("slow", slow), qr.Rule("none", lambda t: t.n_words < 0), qr.Rule("all", lambda t: t.n_words > 0))
    df = spark.createDataFrame([(d, t, 1) for d, t in corpus()], SCHEMA)
    assert [r.name for r in qr.cascade(df, rules)][0] == "all"


def test_rejected_texts_are_not_looked_at_again():
    seen = []

    def count(t):
        seen.append(len(t.offsets) - 1)
        return np.zeros(len(t.offsets) - 1, bool)

    data = np.frombuffer(b"aa bb cc dd", np.uint8)
    texts = qr.Texts(data, np.array([0, 2, 5, 11]))
    rules = [qr.Rule("short", lambda t: t.n_words > 1), qr.Rule("count", count)]
    assert qr.kept_by(rules, texts, np.ones(3, bool)).tolist() == [True, True, False]
    assert seen == [2]


def test_words_do_not_depend_on_blocks():
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"ab \n", np.uint8), 3000)
    data[1000:1400] = 99
    offsets = np.array([0, 0, 700, 1200, 1200, 3000])
    want = word_hashes(data, offsets)
    for step in (7, 64, 999):
        assert all((a == b).all() for a, b in zip(want, word_hashes(data, offsets, step)))
    text = data.tobytes()
    for h, d, at in list(zip(*want))[:50]:
        assert offsets[d] <= at < offsets[d + 1] and text[at] not in b" \n"
    assert len(windows_of(want[0], want[1], 3)[0]) == sum(max(0, n - 2) for n in np.bincount(want[1], minlength=5))


def test_sql(spark):
    from checks.verify import check_engine, compare
    from loglens.llm.queries import ORACLE, QUERIES

    sf = "/root/testdata/sf0.001"
    assert compare(spark, check_engine(sf), "op6", QUERIES["op6_quality_rules"], ORACLE["op6_quality_rules"], sf) == ""
