"""The library without its training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_stands_alone(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".*_cache"))
    ask = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline'])"
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (tmp_path / "repo" / name).unlink()
        said = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
        assert said.returncode == 0, said.stderr
        n, m, rest = said.stdout.split(maxsplit=2)
        assert int(n) >= 119 and int(m) >= 98 and rest.strip() == "[]"
    said = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-k", "not alone"], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert said.returncode == 0, said.stdout
