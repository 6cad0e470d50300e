"""The entry module with and without the subpackage for training data."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())), [q for q in e.queries() if q.startswith(('op', 'pipeline'))])"


def _listed(folder):
    done = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    return done.stdout.split(maxsplit=2)


def _copy(to, *without):
    skip = shutil.ignore_patterns("__pycache__", ".git")
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without and os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", to)
    shutil.copytree(f"{ROOT}/sparquill", f"{to}/sparquill", ignore=lambda d, names: skip(d, names) | ({"llm"} & set(names) & set(without)))
    return to


def test_entry_imports_without_the_subpackage(tmp_path):
    n, extra, own = _listed(_copy(tmp_path, "llm"))  # corpus_pipeline.py is still there
    assert int(n) > 90 and extra == "[]" and own.strip() == "[]"


def test_entry_imports_without_subpackage_and_pipeline(tmp_path):
    n, extra, own = _listed(_copy(tmp_path, "llm", "corpus_pipeline.py"))
    assert int(n) > 90 and extra == "[]" and own.strip() == "[]"
