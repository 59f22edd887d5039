import base64
import hashlib
import os
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from loglens.llm import byte_bpe_codec, word_blocks  # noqa: E402
from loglens.llm.byte_bpe_codec import Ranks, encode_decode  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ALPHABET = list(" aabcdeehinorstt  ABC019.,;:!?()\"'-_#*/<>=²\n\t\réèßñ中国日本語はа🙂\x00\x1c\x85​　\xa0")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def expected(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode_bytes(ids))))
    return sorted(out, key=str)


def digests(df):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()), key=str)


def test_words_merge_as_in_the_library(library):
    table = Ranks(PATH)
    rng = random.Random(3)
    for _ in range(3000):
        word = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))).encode()
        ids = library._encode_single_piece(word)
        assert table.encode(word) == ids
        assert table._long(word) == table._short(word) == (ids if len(ids) > 1 else table._long(word))
        assert table.decode(ids) == word


def test_long_words(library):
    table = Ranks(PATH)
    rng = random.Random(4)
    for word in ("a" * 5000, "ab" * 3000, "ß" * 999, "".join(rng.choice("aehinrst") for _ in range(20000))):
        assert table.encode(word.encode()) == library._encode_single_piece(word)
    assert table.decode(table.encode(b"x" * 1_000_000)) == b"x" * 1_000_000


def test_codes_come_back():
    for values in ([], [0], [191, 192, 193, 65727, 65728, 70000, 4_000_000], [192 + (64 << 16), 5]):
        codes = np.array(values, np.int64)
        assert word_blocks.unpack_codes(word_blocks.pack_codes(codes)).tolist() == values


def test_odd_rows(spark, library):
    rows = [(1, "Hello wörld\n\nx"), (1, "Hello wörld\n\nx"), (2, None), (3, ""), (None, "z" * 20000), (4, "  a  b\t\n "), (5, "it's <|endoftext|>")]
    df = spark.createDataFrame([(*r, 7, "s") for r in rows], "doc_id int, text string, block long, words string")
    out = encode_decode(df, PATH, PATTERN, with_ids=True)
    assert digests(out) == expected(library, rows)
    for row in out.collect():
        assert bytes(row.decoded).decode() == dict(rows).get(row.doc_id, "") or row.doc_id == 2
        assert row.ids == library.encode_ordinary(dict(rows)[row.doc_id] or "")
    assert encode_decode(df.limit(0), PATH, PATTERN).collect() == []


def test_many_small_blocks_share_words(spark, library, monkeypatch):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(["the", "tree", "näive", "x" * 70, "17"]) for _ in range(rng.randint(0, 400)))) for k in range(300)]
    rows += [(k, "The same text, again. " * 40) for k in range(300, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    texts = dict(rows)
    codes = word_blocks.BLOCK_BYTES
    monkeypatch.setattr(word_blocks, "BLOCK_BYTES", 3000)  # for the calls in this process below
    blocks = list(word_blocks.fold(_batches(rows), byte_bpe_codec.regex.compile(PATTERN).findall))
    assert len(blocks) > 50 and sum(len(np.frombuffer(b.column(1)[0].as_py(), np.int64)) for b in blocks) == len(rows)
    for b in blocks:
        row = b.to_pylist()[0]
        words = word_blocks.unpack_words(row["words"])
        assert len(set(words)) == len(words)
        numbers, at = word_blocks.unpack_codes(row["codes"]).tolist(), 0
        for owner, n in zip(np.frombuffer(row["owner"], np.int64).tolist(), np.frombuffer(row["places"], np.int64).tolist()):
            assert b"".join(words[i] for i in numbers[at : at + n]).decode() == texts[owner]
            at += n
    monkeypatch.setattr(word_blocks, "BLOCK_BYTES", codes)
    assert digests(encode_decode(df, PATH, PATTERN)) == expected(library, rows)


def _batches(rows):
    import pyarrow as pa

    for at in range(0, len(rows), 64):
        ids, texts = zip(*rows[at : at + 64])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts), pa.nulls(len(ids), pa.string())], ["d", "t", "l"])


def test_query_on_documents(spark, library):
    from loglens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert digests(QUERIES["op13_byte_bpe"](spark, sf)) == expected(library, docs)
