"""Registered queries next to their check SQL, on the smallest tables.

The whole list runs with ``python -m checks.verify``; here one of each kind.
"""

import os

import pytest

SF = "/root/testdata/sf0.001"
NAMES = """read_audit_files audit_date_prefixes read_export_bundles write_workgroup_csv metric_log_lines
route_events normalize_athena_events dedupe_events enrich_queries polled_data_scanned query_patterns
pattern_examples s3_bucket_stats sql_feature_counts query_complexity ddl_samples_by_type
execution_time_stats migration_flag_examples account_coverage account_rollup merge_export_summaries
readiness_score recommendations ranked_patterns top_users stream_hourly_counts""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def engine():
    pytest.importorskip("duckdb")
    from checks.verify import check_engine

    return check_engine(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, engine, name):
    from checks.oracle import ORACLE
    from checks.queries import QUERIES
    from checks.verify import compare

    assert compare(spark, engine, name, QUERIES[name], ORACLE[name], SF) == ""


def test_every_query_has_a_check():
    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    from checks.oracle import ORACLE

    assert contract.queries().keys() >= contract.oracle_sql().keys() >= ORACLE.keys()
