"""Every query of the core against its DuckDB twin on the smallest tables."""

import os

import pytest

from prismloom.queries import registries

from .twins import assert_same, views

FOLDER = "/root/testdata/sf0.001"
ENTRIES = {n: e for r in registries() for n, e in r.entries.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_twin(spark, con, name):
    assert_same(ENTRIES[name].run(spark, FOLDER), con, ENTRIES[name].sql)


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if not e.sql])
def test_runs(spark, name):
    assert ENTRIES[name].run(spark, FOLDER).schema.fields
