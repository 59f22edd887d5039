import gzip
import re
import glob
import json
import os
import random

import pyarrow as pa

from loglens import sources
from loglens.operators.events import Period
from loglens.sources import audit_scan

PERIOD = Period.of("2024-01-01T00:00:00Z", "2024-01-03T00:00:00Z")


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def records(*ids):
    return json.dumps({"Records": [{"eventID": i, "eventName": "StartQueryExecution", "requestParameters": {"workGroup": "w"}} for i in ids]}).encode()


def fill(root):
    base = f"{root}/AWSLogs/o-1/111/CloudTrail/eu-west-1/2024/01"
    put(f"{base}/01/a.json.gz", gzip.compress(records("a", "b")))
    put(f"{base}/02/two.json.gz", gzip.compress(records()[:-2] + b'{"eventID": "c"}') + gzip.compress(b"]}"))
    put(f"{base}/02/plain.json", records("d"))
    put(f"{base}/02/cut.json.gz", gzip.compress(records("x", "y"))[:-12])
    put(f"{base}/02/not.json.gz", b"\x1f\x8bnot gzip")
    put(f"{base}/02/half.json.gz", gzip.compress(records("x", "y")[:-5]))
    put(f"{base}/02/empty.json.gz", gzip.compress(records()))
    put(f"{base}/02/none.json.gz", gzip.compress(b"{}"))
    put(f"{base}/02/zero.json.gz", b"")
    noise = random.Random(1).randbytes(30000).hex()
    put(f"{base}/02/large.json.gz", gzip.compress(json.dumps({"Records": [{"eventID": noise}]}).encode()))
    put(f"{base}/09/later.json.gz", gzip.compress(records("later")))
    put(f"{root}/AWSLogs/o-1/222/CloudTrail/us-east-1/2024/01/02/a.json.gz", gzip.compress(records("e")))
    put(f"{root}/AWSLogs/o-2/333/CloudTrail/us-east-1/2024/01/02/a.json.gz", gzip.compress(records("other")))


def test_records_and_problems_in_one_read(spark, folder):
    fill(folder)
    scan = sources.scan_org_audit_files(spark, folder, PERIOD, "o-1", max_bytes=20000)
    rows = scan.collect()
    got = sorted((r.account_id, r.record.eventID) for r in rows if r.problem is None)
    assert got == [("111", "a"), ("111", "b"), ("111", "c"), ("111", "d"), ("222", "e")]
    bad = {r.path.rsplit("/", 1)[1]: r.problem for r in rows if r.problem}
    assert sorted(bad) == ["cut.json.gz", "half.json.gz", "large.json.gz", "not.json.gz"]
    assert bad["large.json.gz"] == "too large" and all(p.startswith("unreadable: ") for n, p in bad.items() if n != "large.json.gz")
    assert sources.audit_problems(scan).count() == 4
    text = sources.audit_records(scan).filter("eventID = 'a'").first()
    assert json.loads(text.requestParameters) == {"workGroup": "w"} and text.account_id == "111"


def test_without_a_limit_and_without_an_organization(spark, folder):
    fill(folder)
    scan = sources.scan_org_audit_files(spark, folder, PERIOD, "o-1")
    assert sources.audit_problems(scan).count() == 3 and sources.audit_records(scan).count() == 6
    assert sources.scan_org_audit_files(spark, folder, PERIOD, "") is None


def test_equals_the_json_reader(spark, folder):
    fill(folder)
    scan = sources.audit_records(sources.scan_audit_files(spark, folder))
    whole = sources.read_audit_files(spark, folder)

    def plain(df):  # blanks inside nested JSON are the readers' own
        return sorted((r.eventID, r.eventName, str(r.userIdentity), json.dumps(json.loads(r.requestParameters or "null"))) for r in df.collect())

    assert plain(scan) == plain(whole)


def test_large_files_are_read_twice(folder, monkeypatch):
    monkeypatch.setattr(audit_scan, "HOLD", 500)
    monkeypatch.setattr(audit_scan, "PIECE", 64)
    put(f"{folder}/a.json.gz", gzip.compress(records(*map(str, range(900)))))
    put(f"{folder}/b.json.gz", gzip.compress(records(*map(str, range(900))))[:-9])
    batch = pa.RecordBatch.from_arrays([pa.array([f"{folder}/a.json.gz", f"{folder}/b.json.gz"]), pa.array([1, 1])], ["path", "length"])
    rows = [r for b in audit_scan._scan(lambda p: open(p, "rb"), None, [batch]) for r in b.to_pylist()]
    assert [json.loads(r["body"])["eventID"] for r in rows if r["body"]] == [str(i) for i in range(900)]
    assert [r["path"][-9:] for r in rows if r["problem"]] == ["b.json.gz"]


def test_trail_is_written_record_by_record(spark, monkeypatch):
    """No row holds a folder's records: those grow with the log."""
    from pyspark.sql.types import ArrayType

    from checks import queries

    fed, frame = [], type(spark.range(1))
    write = frame.mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", lambda rows, *more: (fed.append(rows), write(rows, *more))[1])
    root = queries._write_org_files(spark, "/root/testdata/sf0.001")
    assert len(fed) == 1 and not [f for f in fed[0].schema if isinstance(f.dataType, ArrayType)]
    files = [p for p in glob.glob(f"{root}/**/*.json.gz", recursive=True) if re.search(r"/\d+\.json\.gz$", p)]
    sizes = [len(json.loads(gzip.open(p).read())["Records"]) for p in files]
    assert sum(sizes) == fed[0].count() and max(sizes) <= queries.FILE_RECORDS
