"""The rest of the repository without the subpackage llm."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); print(sorted(n for n in q if n.startswith('op') or n == 'pipeline'))"


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_entry_imports_without_llm(tmp_path, pipeline_too):
    copy = tmp_path / "repo"
    left_out = ["llm", ".git", "__pycache__", *(["corpus_pipeline.py"] if pipeline_too else [])]
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(*left_out))
    assert not (copy / "lodestack/llm").exists() and (copy / "corpus_pipeline.py").exists() != pipeline_too
    done = subprocess.run([sys.executable, "-c", ASK], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "[]"


def test_nothing_else_imports_llm():
    for path in (REPO / "lodestack").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "llm" not in path.read_text().replace("lodestack.llm", "llm").split("import"), path
            assert "from .llm" not in path.read_text() and "from ..llm" not in path.read_text() and "lodestack.llm" not in path.read_text()
