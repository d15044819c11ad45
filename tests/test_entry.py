"""The entry module without its optional part, and with a broken one."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') for k in e.queries()))"


def entry_of(folder):
    return subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120,
                          env={**os.environ, "PYTHONPATH": str(folder)})


def test_entry_without_and_with_a_broken_part(tmp_path):
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git", "tests", "corpus_pipeline.py")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    done = entry_of(tmp_path / "repo")
    queries, optional = map(int, done.stdout.split())
    assert queries >= 115 and optional == 0
    broken = tmp_path / "repo/vacancy_spark/llm"
    broken.mkdir()
    (broken / "__init__.py").write_text("import a_module_that_is_not_there\n")
    (broken / "registry.py").write_text("")
    (tmp_path / "repo/corpus_pipeline.py").write_text("from vacancy_spark.llm import registry\n")
    done = entry_of(tmp_path / "repo")
    assert done.returncode and "a_module_that_is_not_there" in done.stderr
