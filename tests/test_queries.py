"""Every registered query of the media pipeline against its SQL."""

from __future__ import annotations

import pytest

from sluicework.plans.queries import QUERIES, SQL
from tests.compare import duck, normal

#: Empty on the smallest tables.
MAY_BE_EMPTY = {"blocklist_match", "blocklist_asset_hits"}


@pytest.fixture(scope="module")
def other(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, other, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), other.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)
    assert len(ours) or name in MAY_BE_EMPTY


def test_three_ticks_keep_every_item(spark, sf_dir):
    rows = QUERIES["admission_ticks"](spark, sf_dir).toPandas()
    assert rows.n.sum() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_entry_module(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
