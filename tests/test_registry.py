"""The driver contract: every registered query runs at sf0.001 and names its
inventory ids; entry() returns rows."""

import pytest

import __spark_entry__ as E
from terrane.registry import load_all

SF = "/root/testdata/sf0.001"
HEAVY = {"live_feed_refresh", "group_load_snapshot"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0


def test_registry_metadata():
    reg = load_all()
    assert len(reg) >= 50
    for name, e in reg.items():
        assert e.fn.__doc__ and e.ids, name
        assert not name.startswith("op")
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(n for n in load_all() if n not in HEAVY))
def test_query_runs(spark, name):
    df = E.queries()[name](spark, SF)
    df.limit(5).collect()
    assert len(df.columns) > 0
