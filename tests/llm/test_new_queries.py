"""Queries whose SQL says the whole result, against that SQL."""

import pytest

from oracle import equal


@pytest.mark.parametrize("name", ["op11_centroids", "op12_exact_dedup", "op13_phrase_mining"])
def test_query_equals_its_sql(spark, name):
    ok, told = equal(spark, name, "/root/testdata/sf0.001")
    assert ok, told
