"""The entry without the training-data folders."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [["casewright/llm", "tests/llm"], ["casewright/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_imports_and_collects_without(tmp_path, gone):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache"))
    for name in gone:
        path = tree / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'edge_view_citations' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tree, capture_output=True).returncode == 0
    if "casewright/llm" in gone:
        got = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=tree, capture_output=True, text=True)
        assert got.returncode == 0, got.stdout[-2000:]
