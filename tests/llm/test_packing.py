import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from loglens.llm.packing import Ids, Packer, closest_fill, pack  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference_ids(texts):
    lib = tokenizers.Tokenizer.from_file(PATH)
    return [e.ids + [0] for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, ids_of, window=1024):
    """Pieces cover each document once, sequences are gapless, and only powers of two are short."""
    by_doc, by_seq = {}, {}
    for doc, start, length, crc, total, seq, offset in rows:
        assert length > 0
        by_doc.setdefault(doc, []).append((start, length, crc, total))
        by_seq.setdefault(seq, []).append((offset, length))
    assert set(by_doc) == set(ids_of)
    for doc, pieces in by_doc.items():
        at = 0
        for start, length, crc, total in sorted(pieces):
            assert start == at and total == len(ids_of[doc])
            assert zlib.crc32(np.array(ids_of[doc][start : start + length], "<u4").tobytes()) == crc
            at += length
        assert at == len(ids_of[doc])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_ids_equal_the_library():
    rng = random.Random(3)
    alphabet = list("  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0    　᠎​''stremdlv abcXYZ019²½.,!?-_éß中の🙂") + ["<|endoftext|>", "'ll", "   "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    own = Ids(PATH)
    for text, want in zip(texts, reference_ids(texts)):
        assert own.of(text).tolist() + [0] == want, repr(text)


def test_ids_of_tokens_beyond_ascii():
    lib = tokenizers.Tokenizer.from_file(PATH)
    tokens = [lib.decode([i], skip_special_tokens=False) for i in range(lib.get_vocab_size())]
    words = [t for t in tokens if not t.isascii()] + ["Erdoğan", "oğlu", "Łódź", "naïveтекст", "aª", "x²'s", "é\u0301l", "n\u0303o"]
    texts = [x for w in words for x in (w, f"Er{w}an", f"é{w}'s {w.strip()}1{w}", f"{w}{w}-{w}")]
    own = Ids(PATH)
    assert own.of("Erdoğan").tolist() == [36, 4372, 48030]
    for text, want in zip(texts, reference_ids(texts)):
        assert own.of(text).tolist() + [0] == want, repr(text)


def test_closest_fill():
    rng = random.Random(4)
    for _ in range(500):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 90)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        counts = {x: items.count(x) for x in items}
        best, used = closest_fill(room, counts)
        assert best == max(s for s in sums if s <= room)
        assert sum(x * n for x, n in used.items()) == best
        assert all(n <= counts[x] for x, n in used.items())


@pytest.mark.parametrize("sizes", [[600] * 50, [1], [1024], [1025, 3], [7] * 1000, [3000, 513, 512, 511], []])
def test_sizes(sizes):
    docs = {d: np.arange(n) + d for d, n in enumerate(sizes)}
    packer = Packer(5, wait=4000, most=8000)
    for d, ids in docs.items():
        packer.add(d, ids)
    packer.finish()
    assert check(packer.rows, {d: x.tolist() for d, x in docs.items()}) == 0


def test_random_sizes():
    rng = random.Random(9)
    docs = {d: np.arange(int(rng.lognormvariate(5.5, 1.5)) + 1) for d in range(3000)}
    packer = Packer(0, wait=1 << 15)
    for d, ids in docs.items():
        packer.add(d, ids)
    packer.finish()
    assert check(packer.rows, {d: x.tolist() for d, x in docs.items()}) == 0
    whole = sum(r[1] == 0 and r[2] == r[4] for r in packer.rows)
    short = sum(len(x) < 1024 for x in docs.values())
    assert whole > 0.98 * short  # cutting is for the end


def test_table(spark):
    texts = {1: None, 2: "", 3: "one two", 4: "word " * 5000, 5: "<|endoftext|> x", 6: "é" * 3000}
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, length int")
    rows = [tuple(r) for r in pack(df, PATH).collect()]
    assert check(rows, dict(zip(texts, reference_ids(texts.values())))) == 0
    twice = spark.createDataFrame([(9, "same", 1), (9, "same", 1), (None, "x", 1)], "doc_id long, text string, length int")
    assert sorted((str(r.doc_id), r.doc_tokens) for r in pack(twice, PATH).collect()) == [("9", 2), ("9", 2), ("None", 2)]
    assert pack(df.limit(0), PATH).collect() == []


def test_query_on_documents(spark):
    from loglens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = dict(zip((r.doc_id for r in docs), reference_ids([r.text for r in docs])))
    assert check([tuple(r) for r in QUERIES["op4_packing"](spark, sf).collect()], ids) == 0
