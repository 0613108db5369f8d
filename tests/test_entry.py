"""The entry points with and without the corpus operators' folders."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("gone", [["llm"], ["llm", "corpus_pipeline.py"]])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    ignore = shutil.ignore_patterns(*gone, ".git", "tests", "__pycache__")
    shutil.copytree(REPO, tmp_path / "copy", ignore=ignore)
    done = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, sql = (line.split() for line in done.stdout.splitlines())
    assert len(queries) == 31 and len(sql) == 27 and "bm25_topk" in queries
    assert not any(q.startswith("op") or q == "pipeline" for q in queries)
