"""The text operators and their pipeline can be deleted: everything else still loads."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

from dwellgrid.catalog import queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(set(e.oracle_sql()) - set(e.queries())))"
TEXT_FOLDERS = ("dwellgrid/llm", "tests/llm")


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_without_the_text_operators(tmp_path, also):
    left_out = {os.path.join(ROOT, p) for p in (*TEXT_FOLDERS, *also)}

    def skip(folder, names):
        return [n for n in names if os.path.join(folder, n) in left_out or n in (".git", "__pycache__")]

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=skip)
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(queries.queries())), "0"]
