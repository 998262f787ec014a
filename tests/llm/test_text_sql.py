"""Queries that SQL can express, whole results."""

import pytest

from compare import connect, rows_of_spark, rows_of_sql
from rowloom.llm.oracle import ORACLE
from rowloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, name):
    want_columns, want = rows_of_sql(connect(sf_dir), ORACLE[name])
    got_columns, got = rows_of_spark(QUERIES[name](spark, sf_dir))
    assert got_columns == want_columns
    assert got == want


def test_one_query_per_operator():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14))
