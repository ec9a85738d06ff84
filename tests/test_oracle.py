"""Every query against its SQL twin on the driver's tables."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from compare import compare, duck

import __spark_entry__ as contract
from askloop.plans.oracle import ORACLE
from askloop.plans.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
# Fits have no SQL twin.
ROWS_ONLY = {"gate_fit_apply"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_contract_without_the_folder_for_training_text():
    """What the contract offers where the pipeline cannot be imported."""
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    shown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(contract.__file__).parent)
    assert shown.stdout.split() == [str(len(QUERIES)), str(len(ORACLE))]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    difference, _ = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_DIR)
    assert difference is None, difference


def test_entry(spark):
    row = contract.entry(spark).first()
    assert row.dataset == "conv" and row.n > 0
