"""The entry point with and without the operators of the corpus pipeline."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(q for q in e.queries() if q[:2] == 'op' and q[2].isdigit()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    """All other queries stay when the folder of those operators is deleted, with or without the pipeline file."""
    from weekcast import catalog

    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "weekcast", copy / "weekcast", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        shutil.copy(ROOT / name, copy / name)
    shown = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, check=True).stdout.split(maxsplit=2)
    assert int(shown[0]) == len(catalog.load())
    assert int(shown[1]) == sum(item.sql is not None for item in catalog.load().values())
    assert shown[2].strip() == "[]"
