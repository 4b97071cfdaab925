"""The entry module without the operators of a training-data pipeline."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


def counted(folder: str) -> list[str]:
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": folder})
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_import_without_llm(tmp_path, pipeline_too):
    """With both folders gone, and with or without the pipeline beside them, the other queries are there."""
    folder = str(tmp_path / "copy")
    skip = shutil.ignore_patterns("llm", "__pycache__", *(["corpus_pipeline.py"] if pipeline_too else []))
    os.mkdir(folder)
    for name in ("rowcaster", "tests"):
        shutil.copytree(f"{ROOT}/{name}", f"{folder}/{name}", ignore=skip)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}") and not (pipeline_too and name == "corpus_pipeline.py"):
            shutil.copy(f"{ROOT}/{name}", folder)
    total, ops, pipeline = counted(folder)
    assert int(total) > 100 and ops == "0" and pipeline == "False"
