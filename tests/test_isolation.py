"""The library stands without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAID = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n == 'pipeline' or n.startswith('op') and n[2].isdigit() for n in q), set(e.oracle_sql()) <= set(q))"


def test_without_the_corpus_operators(tmp_path):
    """With lexiloom/llm and tests/llm deleted, corpus_pipeline.py left or not, the queries of the library are listed."""
    there = tmp_path / "repo"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json", "*.txt"))
    for _ in range(2):
        said = subprocess.run([sys.executable, "-B", "-c", SAID], cwd=there, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
        n, corpus, agree = said.stdout.split() or (0, 0, said.stderr)
        assert int(n) > 80 and corpus == "0" and agree == "True", said.stderr
        (there / "corpus_pipeline.py").unlink(missing_ok=True)
