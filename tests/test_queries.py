"""Every registered query against its oracle SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_oracle(spark, sf_dir, con, name):
    assert difference(spark, queries()[name], oracle_sql()[name], sf_dir, con) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_gives_rows(spark, sf_dir, name):
    assert not queries()[name](spark, sf_dir).isEmpty()


def test_entry(spark):
    assert entry(spark).columns == ["ext", "file_count", "tokens", "lines"]
