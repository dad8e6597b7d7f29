"""Every registered lattice query against SQL that enumerates whole paths."""

import os

import duckdb
import pytest
from conftest import SMALL

from arcloom import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def rows(df, columns):
    return df[columns].sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(catalog.ORACLES[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert len(got) == len(want) > 0
    want, got = rows(want, columns), rows(got, columns)
    for c in columns:
        assert (want[c].astype(got[c].dtype) == got[c]).all(), c


def test_fold_stays_in_the_jvm_with_one_exchange_per_side(spark):
    from arcloom.operators import distance
    from arcloom.sources import derive

    plan = distance.mass(derive.order_lattice(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
