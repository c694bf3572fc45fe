import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOWN = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*q)"


@pytest.mark.parametrize("gone", [("ordertide/llm", "tests/llm"), ("ordertide/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_parts_may_be_deleted(tmp_path, gone):
    tree = shutil.copytree(ROOT, tmp_path / "tree", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", ".pytest_cache"))
    for name in gone:
        (shutil.rmtree if (tree / name).is_dir() else os.remove)(tree / name)
    env = {**os.environ, "PYTHONPATH": str(tree)}
    found = subprocess.run([sys.executable, "-c", SHOWN], cwd=tree, env=env, capture_output=True, text=True)
    assert found.returncode == 0, found.stderr
    names = found.stdout.split()
    assert "flat_merge" in names and "pipeline" not in names
    assert any(n.startswith("op1_") for n in names) == ("ordertide/llm" not in gone)
