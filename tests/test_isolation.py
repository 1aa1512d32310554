"""The library and its entry points without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("leave", ["pipeline", "folder", "nothing"])
def test_entry_without_the_subpackage(tmp_path, leave):
    tree = tmp_path / "tree"
    shutil.copytree(REPO, tree, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.md", "*.json"))
    shutil.rmtree(tree / "sextant" / "llm", ignore_errors=True)
    if leave == "folder":
        (tree / "sextant" / "llm").mkdir()
    if leave != "pipeline":
        (tree / "corpus_pipeline.py").unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    names = subprocess.run([sys.executable, "-c", ASK], cwd=tree, env=env, check=True, capture_output=True, text=True).stdout.split()
    assert "bm25f_all" in names and len(names) > 50
    assert "pipeline" not in names and not [n for n in names if n.startswith("op") and n[2:3].isdigit()]
