"""The driver contract holds without the subpackage of training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), 'pipeline' in q, any(x.startswith('op') and x[2].isdigit() for x in q), set(o) <= set(q))"


def said(folder, before=""):
    out = subprocess.run([sys.executable, "-B", "-c", before + SAY], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


@pytest.mark.parametrize("gone", [["factframe/llm", "tests/llm"], ["factframe/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_queries_without_some_files(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "artifacts"))
    for name in gone:
        path = tmp_path / "repo" / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    from factframe.catalogue import QUERIES

    n, pipeline, operators, named = said(tmp_path / "repo")
    assert (pipeline, named) == ("False", "True")
    if "factframe/llm" in gone:
        assert (int(n), operators) == (len(QUERIES), "False")


def test_queries_without_a_library_that_operators_need():
    from factframe.catalogue import QUERIES

    n, pipeline, operators, named = said(ROOT, "import sys; sys.modules['zstandard'] = None; ")
    assert (int(n), pipeline, operators, named) == (len(QUERIES), "False", "False", "True")
