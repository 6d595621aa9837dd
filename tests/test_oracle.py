"""Every registered query that has SQL gives the same rows in both engines."""

import pytest
from check_oracle import compare

from __spark_entry__ import entry, oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, con, sf, name):
    assert compare(spark, con, name, sf) == ""


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["cluster", "word", "n", "rank"]
