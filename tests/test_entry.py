"""The driver contract holds on a copy without the training-data folders, with and without the pipeline's file."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
ASKED = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'open_alarms' in q and set(o) <= set(q); assert not any(n.startswith('op') and n[2].isdigit() for n in q); assert 'pipeline' not in q"


@pytest.mark.parametrize("file_stays", [True, False])
def test_queries_without_the_training_data_folders(tmp_path, file_stays):
    at = tmp_path / "repo"
    shutil.copytree(HERE, at, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache"))
    if not file_stays:
        (at / "corpus_pipeline.py").unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", ASKED], cwd=at, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
