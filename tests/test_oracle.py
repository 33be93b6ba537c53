"""A spread of registered queries against DuckDB on the smallest data."""

import pytest

import oracle

KEYS = ["norm_doi", "text_metadata", "filename_metadata", "scan_classify", "resolve_paths", "cite_keys", "cache_evict", "merge_fill",
        "dedupe_doi", "snapshot_diff", "undo_state", "paragraphs", "stream_intake"]


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, key):
    folder = "/root/testdata/sf0.001"
    difference, _ = oracle.compare(spark, oracle.connect(folder), key, folder)
    assert not difference or difference.startswith(" ")


def test_every_oracle_has_a_query():
    assert set(oracle.app.oracle_sql()) <= set(oracle.app.queries())


@pytest.mark.parametrize("key", ["title_keys", "extract_doi", "resolve_paths", "merge_fill", "dedupe_title", "cache_evict"])
def test_plans_stay_distributed(spark, key):
    plan = oracle.app.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
