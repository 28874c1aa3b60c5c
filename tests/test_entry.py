"""The entry module, with and without the optional corpus subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(folder):
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*q)"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_rest_works_alone(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    rest = names(tmp_path / "r")
    assert "composite_online" in rest and not any(n.startswith("op") and n[2:3].isdigit() for n in rest) and "pipeline" not in rest
    assert rest <= names(ROOT)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "courierlake").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
