"""Every core query against its SQL on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from conftest import DATA
from oracle import rows_of, rows_of_sql

CORE = {k: (q, m.oracle_sql().get(k)) for m in entry._modules() if not m.__name__.startswith("sightline.llm") for k, q in m.queries().items()}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    query, sql = CORE[name]
    df = query(spark, DATA)
    got = rows_of(df)
    if sql is not None:
        assert got == rows_of_sql(duck, sql, df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_from_another_folder(tmp_path):
    """Python workers find the package although neither PYTHONPATH nor the working folder leads to it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; from sightline.session import local_session; print('ROWS', e.queries()['p2_found'](local_session('x', 2), {DATA!r}).count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
