"""Summary documents of the checks: how they are built."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_each_section_is_shuffled_once(spark, monkeypatch):
    from checks import queries

    stored, write = [], queries.store_table
    monkeypatch.setattr(queries, "store_table", lambda rows, name: (stored.append(rows), write(rows, name))[1])
    queries._summaries(spark, SF)
    plan = stored[0]._jdf.queryExecution().executedPlan().toString()
    sections = plan.count("FileScan parquet")
    assert sections >= 6 and plan.count("Exchange hashpartitioning") <= sections
