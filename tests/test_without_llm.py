"""The rest of the library stands without the llm subpackage and its pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_imports_without_llm(tmp_path):
    shutil.copytree(ROOT / "ordkv", tmp_path / "ordkv", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'live_scan' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_names_llm():
    for f in (ROOT / "ordkv").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "ordkv").parts[0]:
            assert "llm" not in f.read_text(), f
