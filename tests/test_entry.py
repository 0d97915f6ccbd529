"""The entry points with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

from runlens.plans import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, left_out):
    shutil.copytree(os.path.join(ROOT, "runlens"), tmp_path / "runlens", ignore=shutil.ignore_patterns("__pycache__", *left_out))
    for name in {"__spark_entry__.py", "corpus_pipeline.py"} - set(left_out):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    done = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)},
                          capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(catalogue.queries())), str(len(catalogue.oracles())), "False"]


def test_a_missing_library_is_no_missing_subpackage(tmp_path, monkeypatch):
    import __spark_entry__ as entry

    (tmp_path / "needs_more.py").write_text("import a_library_that_is_not_there\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        entry._optional("needs_more")
