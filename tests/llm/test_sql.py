"""Queries of the package that SQL can express, against their SQL."""

from __future__ import annotations

import pytest

from rowcaster.llm.queries import ORACLE, QUERIES

from ..check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal_to_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, QUERIES[name], ORACLE[name], FOLDER) is None
