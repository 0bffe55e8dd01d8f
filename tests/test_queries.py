import pytest

import __spark_entry__ as entry
from check import compare, connect

# SQL over whole texts that takes long even on the smallest tables is left to ``check.py``.
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_entry(spark):
    assert entry.entry(spark).columns == ["text"]
    assert not entry.entry(spark).isEmpty()


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, small, name):
    line = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), small)
    assert line.startswith(("ok", "rows")), line


LAZY = [n for n in NAMES if not n.startswith(("inc_checkpoint", "inc_dedup"))]


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_join(spark, small, name):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
