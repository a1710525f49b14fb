"""Every registered plan against its SQL on the smallest tables."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import compare, connect

from codeloom.plans import ORACLE_SQL, QUERIES

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(AT)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    said = compare(spark, con, name, QUERIES[name], ORACLE_SQL.get(name), AT)
    assert "DIFFERENT" not in said, said


def test_entry_without_llm(tmp_path):
    """A copy without the subpackage and the pipeline has all other queries; a missing library is no reason to go without."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "codeloom"), tmp_path / "codeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(*e.queries())"
    run = lambda: subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert set(run().stdout.split()) == set(QUERIES)
    (tmp_path / "corpus_pipeline.py").write_text("import a_library_that_is_missing\n")
    assert "a_library_that_is_missing" in run().stderr
