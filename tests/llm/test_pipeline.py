"""Every stage of the pipeline on what its predecessor kept, against plain Python."""

import os
import re

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as cp  # noqa: E402
import test_line_dedup  # noqa: E402
import test_near_dedup  # noqa: E402
import test_packing  # noqa: E402
import test_suffix_dedup  # noqa: E402

from loglens.llm import classifier, near_dedup  # noqa: E402
from loglens.session import store_table  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        docs = store_table(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_columns(stages):
    for docs in stages[:-1]:
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.schema == stages[0].schema
    for docs in stages[2:5]:
        assert docs.filter("n_chars <> length(text)").isEmpty()


def test_classifier(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    gone = {r.doc_id for r in classifier.classify(stages[0], labels).filter("rejected").collect()}
    assert gone
    assert {r.doc_id for r in stages[1].collect()} == {d for d, _ in pairs(stages[0])} - gone
    clean = {r.doc_id for r in labels.filter("quality = 1 AND toxic = 0").collect()}
    assert len(gone & clean) <= 0.02 * len(clean)


def test_lines(stages):
    before, after = pairs(stages[1]), dict(pairs(stages[2]))
    for d, _, _, sha in test_line_dedup.brute(before):
        assert test_suffix_dedup.hashlib.sha256(after.pop(d).encode()).hexdigest() == sha
    assert not after


def test_near(stages):
    before = pairs(stages[2])
    classes, sims = test_near_dedup.brute(before)
    assert min(abs(s - near_dedup.SIMILARITY) for s in sims.values()) > 1e-6
    assert sorted(d for d, _ in pairs(stages[3])) == sorted(d for d, c in classes if d == c)


def test_suffixes(stages):
    import hashlib

    want = {r[0]: r for r in test_suffix_dedup.brute(pairs(stages[3]))}
    for d, t in pairs(stages[4]):
        size, gone, sha = want[d][1], want[d][2], want[d][4]
        assert len(t.encode()) <= size - gone
        if len(t.encode()) == size - gone:  # no character was cut
            assert hashlib.sha256(t.encode()).hexdigest() == sha


def test_packing_stage(stages):
    before = dict(pairs(stages[4]))
    ids = dict(zip(before, test_packing.reference_ids(before.values())))
    assert test_packing.check([tuple(r) for r in stages[5].collect()], ids) == 0


def test_run(spark, stages):
    assert cp.run(spark, SF).count() == stages[5].count()


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b", None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            table = store_table(stage(spark, table, SF), name)
    assert table.count() == 0


def test_rows_that_repeat_id_and_text_leave_one(spark):
    rows = [(1, "one text of a few words here", "en", "a", 3), (1, "one text of a few words here", "en", "b", 3), (2, None, "en", "a", 0)]
    rows += [(2, None, "en", "a", 0), (None, "alone", "de", "a", 5), (3, "other words stand here now ok", "fr", "a", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.near_dedup(spark, docs, SF).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str(x) for x in {(r[0], r[1]) for r in rows})
    assert cp.near_dedup(spark, docs.limit(0), SF).collect() == []


def test_near_shuffles_whole_documents_once(spark):
    """Beside the classes, which are stored by then."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = cp.near_dedup(spark, docs, SF)._jdf.queryExecution()
        text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(plan, "formatted")
    finally:
        spark.conf.set(name, before)
    moved = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: (.*)", text, re.M)
    assert len(moved) > 1 and sum("source#" in columns for columns in moved) == 1
