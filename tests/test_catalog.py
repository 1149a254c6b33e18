"""Every query with a SQL equivalent against DuckDB, the others for a stable schema and rows."""

import pytest

from braidlog.plans import analysis, formats, records, views  # noqa: F401
from braidlog.plans.catalog import ORACLES, QUERIES
from conftest import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    same(QUERIES[name](spark, sf_dir), duck.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns
    assert df.count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
