"""Every registered query against its DuckDB twin on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import pytest

from conftest import SF_SMALL
from glossa.plans import REGISTRY
from oracle import compare, duck

_CON = {}


def con():
    if "c" not in _CON:
        _CON["c"] = duck(SF_SMALL)
    return _CON["c"]


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_query_matches_oracle(spark, name):
    ok, msg = compare(REGISTRY[name].fn(spark, SF_SMALL), con(), REGISTRY[name].sql)
    assert ok, msg


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if not q.sql))
def test_query_without_oracle_runs(spark, name):
    assert REGISTRY[name].fn(spark, SF_SMALL).count() > 0
