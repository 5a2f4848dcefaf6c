"""Registered queries against their SQL on the smallest sample."""

from __future__ import annotations

import pytest
from parity import compare

from rtshop.plans.oracle import ORACLE
from rtshop.plans.registry import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    same, note = compare(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLE[name])
    assert same, note


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
