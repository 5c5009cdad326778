import pytest

from cellgrid.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert {r.event_type: r.cnt for r in e.entry(spark).collect()}
    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "cellgrid", tmp_path / "cellgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(catalogue.QUERIES)), "False"], out.stderr
