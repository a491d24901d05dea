"""The text operators' SQL on the smallest tables."""

import os
import sys

import pytest

from thornweave.llm import registry

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from test_queries import compare  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, sf, name):
    compare(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf)
