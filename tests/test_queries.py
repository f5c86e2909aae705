"""Every catalogue query against its SQL, and what its plan must not hold."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest

from prismata.plans import catalogue

from .compare import connect, rows


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, con, small_dir, name):
    got = catalogue.QUERIES[name](spark, small_dir).toPandas()
    assert name in catalogue.ORACLE_SQL
    want = con.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if not n.startswith("stream_")))
def test_plans_stay_inside_the_engine(spark, small_dir, name):
    """No cross join of tables and no Python in any catalogue query."""
    p = plan(catalogue.QUERIES[name](spark, small_dir))
    assert "CartesianProduct" not in p
    assert "Python" not in p and "Pandas" not in p and "Arrow" not in p


def test_filters_reach_the_scan(spark, small_dir):
    p = plan(catalogue.QUERIES["facet_range_scalar"](spark, small_dir))
    assert "PushedFilters: [" in p
    read = next(line for line in p.splitlines() if "ReadSchema" in line)
    assert "p_type" not in read


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() >= 0 and df.schema == entry.entry(spark).schema
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_entry_without_the_training_operators(tmp_path):
    """The guard: with the subpackage and the pipeline deleted, the rest imports and registers."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "prismata", tmp_path / "prismata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = """
import __spark_entry__ as e
assert not [k for k in e.queries() if k.startswith("op") or k == "pipeline"]
assert len(e.queries()) == len(e.oracle_sql()) > 150
"""
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
