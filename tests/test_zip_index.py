import json
import random
import zipfile

import pyarrow as pa
import pytest

from loglens import sources
from loglens.sources import zip_index
from loglens.sources.json_items import items_of


def random_value(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 3 else 4)
    if kind < 2:
        return rng.choice([0, -1.5e10, 12345678901234567890, True, False, None, 7])
    if kind < 5:
        return "".join(rng.choice('aé"\\\n{}[],:中🙂 ') for _ in range(rng.randint(0, 12)))
    if kind == 5:
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {f"k{i}": random_value(rng, depth + 1) for i in range(rng.randint(0, 4))}


def pieces(data, rng):
    at = 0
    while at < len(data):
        n = rng.choice([1, 2, 3, 7, 50])
        yield data[at : at + n]
        at += n


def test_items_whatever_the_pieces():
    rng = random.Random(4)
    for _ in range(400):
        value = random_value(rng) if rng.random() < 0.3 else [random_value(rng) for _ in range(rng.randint(0, 6))]
        text = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        items = [json.loads(x) for x in items_of(pieces(f" {text}\n".encode(), rng))]
        assert items == (value if isinstance(value, list) else [value])


def test_broken_text():
    rng = random.Random(5)
    for text in ('', '[', '[1', '[1,', '[1,]', '[1 2]', '{"a":', '[{"a":1}', '"abc', 'nul', '[1]]', '1 2', '[1] x', 'x'):
        with pytest.raises(ValueError):
            list(items_of(pieces(text.encode(), rng)))
    with pytest.raises(ValueError):
        list(items_of(iter([b'["\xff"]'])))
    with pytest.raises(ValueError):
        list(items_of(iter([b'["\xc3'])))


def test_items_of_one_entry():
    rng = random.Random(6)
    for _ in range(200):
        value = {f"k{i}": random_value(rng) for i in range(rng.randint(0, 3))}
        wanted = [random_value(rng) for _ in range(rng.randint(0, 4))]
        entries = list(value.items()) + [("Records", wanted)]
        rng.shuffle(entries)
        text = json.dumps(dict(entries), indent=rng.choice([None, 1]))
        assert [json.loads(x) for x in items_of(pieces(text.encode(), rng), "Records")] == wanted
    assert list(items_of(iter([b'{"a": 1, "Records": null}']), "Records")) == []
    assert list(items_of(iter([b"{}"]), "Records")) == []
    for text in (b"[]", b"{", b'{"Records": [1', b'{"Records": [1]', b'{"Records" [1]}', b'{"Records": [1],}', b"{1: 2}", b""):
        with pytest.raises(ValueError):
            list(items_of(iter([text]), "Records"))


def write(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as bundle:
        for name, text in members.items():
            bundle.writestr(name, text)


def read(spark, folder):
    rows = sources.read_indexed_members(sources.bundle_index(spark, folder), task_bytes=2000).collect()
    return [(r.file.rsplit("/", 1)[1], r.member, r.position, r.body and json.loads(r.body), r.error is not None) for r in rows]


def test_members_and_broken_ones(spark, folder):
    events = [{"event_id": str(i), "text": "é" * (i % 50)} for i in range(5000)]
    write(f"{folder}/a.zip", {"summary.json": "{}", "athena_events.json": json.dumps(events), "other.json": "[1]"})
    write(f"{folder}/stored.zip", {"s3_events.json": "[]", "athena_events.json": "[1, 2]"}, zipfile.ZIP_STORED)
    write(f"{folder}/cut.zip", {"summary.json": "{}", "athena_events.json": '[{"a": 1}, {"b"'})
    write(f"{folder}/method.zip", {"summary.json": "{}", "athena_events.json": "[1]"}, zipfile.ZIP_LZMA)
    with open(f"{folder}/a.zip", "rb") as f:
        data = f.read()
    with open(f"{folder}/half.zip", "wb") as f:
        f.write(data[: len(data) // 2])
    damaged = bytearray(data)
    damaged[3000] ^= 255
    with open(f"{folder}/damaged.zip", "wb") as f:
        f.write(damaged)
    with open(f"{folder}/prefixed.zip", "wb") as f:
        f.write(b"#!/bin/sh\n" + data)
    got = read(spark, folder)
    for name in ("a.zip", "prefixed.zip"):
        mine = [g for g in got if g[0] == name]
        assert sorted((g[2], g[3]["event_id"]) for g in mine if g[1] == "athena_events.json") == [(i, str(i)) for i in range(5000)]
        assert [g[3] for g in mine if g[1] == "summary.json"] == [{}] and not any(g[4] for g in mine)
    assert sorted(g[3] for g in got if g[0] == "stored.zip") == [1, 2]
    assert [g for g in got if g[0] == "cut.zip" and g[1] != "summary.json"] == [("cut.zip", "athena_events.json", None, None, True)]
    assert ("half.zip", None, None, None, True) in got and ("damaged.zip", "athena_events.json", None, None, True) in got
    assert ("method.zip", "athena_events.json", None, None, True) in got
    assert len([g for g in got if g[4]]) == 5  # method.zip has two
    assert ("damaged.zip", "summary.json", 0, {}, False) in got


def test_empty_folder(spark, folder):
    assert sources.read_indexed_members(sources.bundle_index(spark, folder)).collect() == []


def test_large_members_are_checked_before_they_are_given(folder, monkeypatch):
    monkeypatch.setattr(zip_index, "HOLD", 10)
    monkeypatch.setattr(zip_index, "PIECE", 100)
    write(f"{folder}/a.zip", {"athena_events.json": json.dumps(list(range(2000)))})
    write(f"{folder}/b.zip", {"athena_events.json": json.dumps(list(range(2000)))[:-1]})
    reads = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def seek(self, *a):
            return self.file.seek(*a)

        def tell(self):
            return self.file.tell()

        def seekable(self):
            return True

        def read(self, n=-1):
            data = self.file.read(n)
            reads.append(len(data))
            return data

    def open_file(path):
        return Counted(open(path, "rb"))

    paths = pa.RecordBatch.from_arrays([pa.array([f"{folder}/a.zip", f"{folder}/b.zip"])], ["path"])
    (index,) = zip_index._index(open_file, ("athena_events.json",), [paths])
    assert sum(reads) < 1500  # the directories, not the members
    assert index.column("size").to_pylist() == [len(json.dumps(list(range(2000))))] * 1 + [len(json.dumps(list(range(2000)))) - 1]
    rows = [r for batch in zip_index._read(open_file, [index]) for r in batch.to_pylist()]
    assert [json.loads(r["body"]) for r in rows if r["body"]] == list(range(2000))
    assert [r["file"][-5:] for r in rows if r["error"]] == ["b.zip"]
    assert max(reads) <= max(200, 100)
