"""Every registered query against its SQL, whole results."""

import pytest

import __spark_entry__ as entry
from compare import connect, rows_of_spark, rows_of_sql
from rowloom.plans.oracle import ORACLE
from rowloom.plans.queries import QUERIES



def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= entry.queries().items() and ORACLE.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, name):
    want_columns, want = rows_of_sql(connect(sf_dir), ORACLE[name])
    got_columns, got = rows_of_spark(QUERIES[name](spark, sf_dir))
    assert got_columns == want_columns
    assert len(got) == len(want)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
