import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from loglens.llm.sentencepiece_codec import Codec, encode_decode  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = list(" aabcdeehinorstt  ABC019.,;:!?()\"'-_#*/<>=²\n\t\r▁éèßñ中国日本語はа🙂\x00​　\xa0")


@pytest.fixture(scope="module")
def pair():
    return Codec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_random_texts(pair):
    codec, lib = pair
    rng = random.Random(5)
    for k in range(4000):
        words = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))]
        text = rng.choice([" ", "", "\n"]).join(words)
        ids = lib.encode(text) + [lib.eos_id()]
        assert codec.encode(text) == ids, repr(text)
        assert codec.decode(ids) == lib.decode(ids), repr(text)


def test_long_and_odd(pair):
    codec, lib = pair
    for text in ["", " ", "   ", "a" * 3000, " " * 1000, "ab " * 500, "=" * 700, "\n" * 50, "<s></s><unk><0x41>", "².²,"]:
        assert codec.encode(text) == lib.encode(text) + [2]
        assert codec.decode(codec.encode(text)) == lib.decode(lib.encode(text))


def test_lone_bytes_decode(pair):
    codec, lib = pair
    for ids in ([3 + 0xC3], [3 + 0xC3, 3 + 0xA9], [264, 3 + 0xE2, 3 + 0x82, 264], [2, 1, 264], [259, 259]):
        assert codec.decode(ids) == lib.decode(ids)


def test_table(spark):
    _, lib = sentencepiece, sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(1, "Hello wörld\n\nx", 7), (1, "Hello wörld\n\nx", 7), (2, None, 7), (3, "", None), (None, "z" * 20000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    want = []
    for d, t, _ in rows:
        ids = lib.encode(t or "") + [2]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)), ids))
    out = encode_decode(df, MODEL, with_ids=True).collect()
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, want))
    assert encode_decode(df.limit(0), MODEL).collect() == []


def test_query_on_documents(spark):
    from loglens.llm.queries import QUERIES

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op10_sentencepiece"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id]) + [2]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
