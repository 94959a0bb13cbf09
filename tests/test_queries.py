"""Every registered query beside its SQL, on the smallest tables."""

import importlib

import pytest
from compare import same

from scenewright.plans.oracles import ORACLES
from scenewright.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    same(spark, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).columns == ["src", "dst", "score"]
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
