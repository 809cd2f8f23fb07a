"""The correctness gate: every query of the catalog against its DuckDB twin at
sf0.01. The optional training-data queries have their own tests."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry
from hitlens.plans.catalog import QUERIES
from hitlens.plans.oracle import ORACLE as SQL

from .conftest import SF01
from .oracle_check import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    n, problems = compare(spark, con, name, QUERIES[name], SQL[name], SF01)
    assert not problems, problems
    assert n > 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["level", "site_id", "stat_time", "key", "requests"]
    assert df.count() > 0


def test_catalog_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry_survives_a_missing_library():
    """Without a library of the optional operators the catalog still stands."""
    code = ("import sys; sys.modules['xxhash'] = None; import warnings; warnings.simplefilter('ignore');"
            "import __spark_entry__ as e; from hitlens.plans.catalog import QUERIES;"
            "assert set(e.queries()) >= set(QUERIES) and set(e.oracle_sql()) >= set(QUERIES); print('ok')")
    done = subprocess.run([sys.executable, "-c", code], cwd=entry._HERE, capture_output=True, text=True)
    assert done.stdout.strip() == "ok", done.stderr
