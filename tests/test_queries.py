"""Every registered query of this package against its SQL, and the driver's entry point."""

from __future__ import annotations

import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from skeinwork.plans import registry
from tests import compare

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def differing(request, spark):
    """What differs, by query, for all chosen queries: planning takes most of the time, so several are planned at once."""
    con, queries, sql = compare.connection(SF), registry.queries(), registry.oracle_sql()
    chosen = [i.callspec.params["name"] for i in request.session.items if getattr(i, "originalname", "") == "test_against_sql"]
    pool = ThreadPoolExecutor(6)
    yield {n: pool.submit(compare.differences, spark, queries[n], sql[n], SF, con.cursor()) for n in chosen}
    pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(differing, name):
    assert not differing[name].result()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_names_are_told_without_a_session():
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
