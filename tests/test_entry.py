from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("without", [["flowlens/llm", "tests/llm"], ["flowlens/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_corpus_operators(tmp_path, without):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *[Path(w).name for w in without]))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(s) <= set(q) and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=at, env={**os.environ, "PYTHONPATH": str(at)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    # an empty folder that is left behind, as with leftover bytecode, is no subpackage
    (at / "flowlens" / "llm" / "__pycache__").mkdir(parents=True)
    done = subprocess.run([sys.executable, "-c", code], cwd=at, env={**os.environ, "PYTHONPATH": str(at)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
