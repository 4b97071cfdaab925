"""Every named query against its SQL twin, or at least non-empty, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
# slow ones whose operators have their own tests in test_models.py
ELSEWHERE = {
    "parameter_search", "calibration_choice", "calibrated_sigmoid", "calibrated_isotonic", "out_of_fold_metrics"
}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equal_to_sql(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - ELSEWHERE))
def test_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "prediction", "risk_level", "probability"]
