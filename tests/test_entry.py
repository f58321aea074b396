"""The driver contract with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


def counts(folder) -> list[str]:
    env = os.environ | {"PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", ASK], cwd=folder, env=env, check=True, capture_output=True, text=True).stdout.split()


@pytest.mark.parametrize("gone", [("skylattice/llm", "tests/llm"), ("skylattice/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *(os.path.basename(g) for g in gone)))
    total, operators, pipeline = counts(copy)
    assert int(total) >= 50 and operators == "0" and pipeline == "False"
