import hashlib
import random

import numpy as np

from loglens.llm.line_dedup import KEY, CuckooFilter, LineIndex, line_dedup

SCHEMA = "doc_id long, text string, line int"
BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(BLANKS).translate(LOWER)


def brute(rows):
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    least = {k: min(v, key=lambda d: (d is not None, d or 0)) for k, v in holders.items() if len(v) > 1 and len(k) >= 10}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if least.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, ids):
    rng = random.Random(seed)
    pool = ["common line %d é" % i for i in range(30)] + ["short", "É" * 9, "É" * 10, "x" * 10, " padded line", "a\x1cb line here"]
    pool += [x.upper() for x in pool] + ["  " + x + "\t\r" for x in pool[:10]]
    return [(d, "\n".join(rng.choice([rng.choice(pool), f"own {rng.random()}", ""]) for _ in range(rng.randint(0, 12)))) for d in ids]


def test_brute_force(spark):
    rows = corpus(1, range(200)) + [(900, None), (901, ""), (None, "common line 1 é\nother"), (5, "common line 2 é"), (5, "common line 2 é")]
    assert got(line_dedup(frame(spark, rows))) == brute(rows)
    assert got(line_dedup(frame(spark, []))) == []


def test_insert_and_delete(spark):
    a, b = corpus(2, range(0, 90)), corpus(3, range(90, 160))
    index = LineIndex.empty(spark, 6).insert(frame(spark, a)).insert(frame(spark, b))
    assert got(index.dedup(frame(spark, a + b))) == brute(a + b)
    gone = set(range(0, 160, 3)) | {1, 2}
    less = index.delete(spark.createDataFrame([(d,) for d in gone], "doc_id long"))
    rest = [r for r in a + b if r[0] not in gone]
    assert got(less.dedup(frame(spark, rest))) == brute(rest)
    # The filters hold the live keys and nothing else.
    for row in less.shards.collect():
        live = np.unique(np.frombuffer(row.keys, KEY))
        index = CuckooFilter.load(row["filter"])
        assert np.count_nonzero(index.table) == len(live)
        assert index.contains(live).all()
    back = less.insert(frame(spark, [r for r in a + b if r[0] in gone]))
    assert got(back.dedup(frame(spark, a + b))) == brute(a + b)


def test_filter():
    rng = np.random.default_rng(0)
    keys = np.zeros(5000, KEY)
    keys["a"], keys["b"] = rng.integers(0, 1 << 63, 5000), rng.integers(0, 1 << 63, 5000) * 2
    index = CuckooFilter.of(keys[:3000])
    assert index.contains(keys[:3000]).all()
    assert index.contains(keys[3000:]).mean() < 0.01
    index.delete(keys[:1000])
    assert np.count_nonzero(index.table) == 2000 and index.contains(keys[1000:3000]).all()
    assert not CuckooFilter(10).insert(keys)  # too full: the caller builds a larger one


def test_sql(spark):
    from checks.verify import check_engine, compare
    from loglens.llm.queries import ORACLE, QUERIES

    sf = "/root/testdata/sf0.001"
    assert compare(spark, check_engine(sf), "op3", QUERIES["op3_line_dedup"], ORACLE["op3_line_dedup"], sf) == ""
