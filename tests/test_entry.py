"""The rest stands by itself where the corpus operators aren't there."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("gone", [("glyphshift/llm", "tests/llm"), ("glyphshift/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    for name in ("glyphshift", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    there = (tmp_path / "glyphshift/llm").exists()
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=tmp_path, capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONDONTWRITEBYTECODE": "1"})
    found = run("-c", COUNT)
    assert found.returncode == 0, found.stderr
    total, corpus, pipeline = found.stdout.split()
    assert int(total) - int(corpus) >= 75 and pipeline == "False" and int(corpus) == (13 if gone == ("corpus_pipeline.py",) and there else 0)
    collected = run("-m", "pytest", "--collect-only", "-q", "tests/test_queries.py", "-p", "no:cacheprovider")
    assert collected.returncode == 0, collected.stdout
