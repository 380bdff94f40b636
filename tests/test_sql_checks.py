"""Every registered query runs; those with SQL give the rows DuckDB gives."""

import importlib.util
import os

import pytest

import __spark_entry__ as contract

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"

spec = importlib.util.spec_from_file_location(
    "check_oracle", os.path.join(ROOT, "tools", "check_oracle.py")
)
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    text, good = check.compare(spark, con, FOLDER, name)
    assert good, text


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1


def test_oracle_names_are_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
