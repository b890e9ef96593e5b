"""The library without its text subpackage."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_points_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "strandline", tmp_path / "strandline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_entry_points_with_a_subpackage_that_cannot_be_imported(tmp_path):
    shutil.copytree(ROOT / "strandline", tmp_path / "strandline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "strandline" / "llm").mkdir()
    (tmp_path / "strandline" / "llm" / "__init__.py").write_text("import a_library_that_is_not_there\n")
    (tmp_path / "corpus_pipeline.py").write_text("from strandline.llm import queries\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 100 and 'pipeline' not in e.queries()"], cwd=tmp_path, env=env, check=True)


def test_nothing_imports_the_subpackage():
    for path in (ROOT / "strandline").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
