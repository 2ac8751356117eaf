"""Registered queries against their SQL twins.

By default every third query of each family runs; SOWMILL_FULL=1 runs all.
"""

from __future__ import annotations

import os

import pytest
from oracle_check import compare, connect

from sowmill.bind import registry

registry.load()
FAMILIES: dict[str, list[str]] = {}
for _name in sorted(registry.QUERIES):
    FAMILIES.setdefault(_name[:2], []).append(_name)
NAMES = [n for names in FAMILIES.values() for n in (names if os.environ.get("SOWMILL_FULL") else names[::3])]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, con, name):
    got, _, problem = compare(spark, con, registry.QUERIES[name], registry.ORACLE.get(name), sf_dir)
    assert got, "no rows"
    assert not problem, problem


def test_every_query_has_a_twin_or_is_listed():
    without = sorted(set(registry.QUERIES) - set(registry.ORACLE))
    assert without == ["ud04_similarity_ratio"]
