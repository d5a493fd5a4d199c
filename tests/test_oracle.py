"""Every registered query against its DuckDB oracle on sf0.001 (the driver's check in small)."""

import os

import pytest

from tests.oracle_harness import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_all_queries_match_oracle(spark):
    res = compare(spark, SF, verbose=False)
    bad = {k: v for k, v in res.items() if v[0] == "FAIL"}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as se

    df = se.entry(spark)
    assert df.count() > 0
    assert set(se.oracle_sql()) <= set(se.queries())
