"""Every query of the catalogue against its SQL on the tables of sf0.01."""

import pytest
from compare import DATA, hold

from stratalith import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, name):
    assert hold(catalogue.QUERIES[name](spark, f"{DATA}/sf0.01"), catalogue.SQL[name], "sf0.01") > 0


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, f"{DATA}/sf0.01").count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
