"""Every query of the library against its SQL on the smallest tables."""

import pytest

from shelfwise.plans import registry
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    if name not in registry.SQL:
        assert got.columns and got.collect() is not None
        return
    want = con.execute(registry.SQL[name])
    names, values = [d[0] for d in want.description], want.fetchall()
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, values)
