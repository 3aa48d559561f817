"""The library without its training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as c; print(len(c.queries()), len(c.oracle_sql()), any(n == 'pipeline' or n[:2] == 'op' for n in c.queries()))"


@pytest.mark.parametrize("left_over", [False, True])
def test_without_llm(tmp_path, left_over):
    """Imports and keeps its own queries; also where the emptied folder still holds compiled files."""
    from bookloom.plans import ORACLES, QUERIES

    shutil.copytree(ROOT / "bookloom", tmp_path / "bookloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left_over:
        (tmp_path / "bookloom" / "llm" / "__pycache__").mkdir(parents=True)
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLES)), "False"]


def test_nothing_else_imports_it():
    for path in (ROOT / "bookloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "bookloom").parts:
            assert "bookloom.llm" not in path.read_text(), path
