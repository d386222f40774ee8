"""Every registered query against its DuckDB SQL, on whole tables."""

import pytest

from docketry.registry.compare import connect, differences
from docketry.registry.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, duck, name):
    assert differences(QUERIES[name](spark, sf), duck, ORACLES[name]) == []
