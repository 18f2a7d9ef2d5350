"""The engine without the subpackage for corpora."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

PROBE = """
import __spark_entry__ as entry
names = set(entry.queries())
assert "dql_table" in names and not any(n.startswith("op") and n[2:3].isdigit() for n in names) and "pipeline" not in names, names
assert set(entry.oracle_sql()) <= names
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_corpus_operators(tmp_path, pipeline):
    """Also where the pipeline's file is still there."""
    copy = str(tmp_path / "copy")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
