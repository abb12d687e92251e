"""Every registered query against its DuckDB SQL on a small scale factor."""

from __future__ import annotations

import pytest

from quillspark.plans import registry
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, compare, name):
    got = registry.QUERIES[name](spark, f"{DATA}/sf0.001")
    if name in registry.ORACLE:
        compare(got, registry.ORACLE[name], f"{DATA}/sf0.001")
    else:
        got.collect()


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.QUERIES and set(registry.ORACLE) <= set(registry.QUERIES)
