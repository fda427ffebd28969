"""The library stands without its optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), sum(n == 'pipeline' or n.startswith('op') for n in q))"


def _copy(target, *left_out):
    shutil.copytree(ROOT, target, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", ".pytest_cache"))
    for name in left_out:
        path = os.path.join(target, name)
        shutil.rmtree(path) if os.path.isdir(path) else os.path.exists(path) and os.remove(path)
    return subprocess.run([sys.executable, "-c", ASK], cwd=target, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(target)})


def test_queries_without_the_subpackage(tmp_path):
    folders = ("sievework/llm", "tests/llm")
    for i, left_out in enumerate((folders, (*folders, "corpus_pipeline.py"))):
        run = _copy(tmp_path / str(i), *left_out)
        assert run.returncode == 0, run.stderr
        n, sql, extra = map(int, run.stdout.split())
        assert n >= sql > 150 and extra == 0


def test_core_names_no_optional_module():
    for folder, dirs, files in os.walk(os.path.join(ROOT, "sievework")):
        dirs[:] = [d for d in dirs if d not in ("llm", "__pycache__")]
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "sievework.llm" not in f.read(), name
