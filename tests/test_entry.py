import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tessera.plans.catalogue import QUERIES

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_entry_works_without_the_llm_folders(tmp_path, pipeline):
    gone = ["llm"] + ["corpus_pipeline.py"] * (not pipeline)
    for name in ("tessera", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if not source.exists() or name in gone:
            continue
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns(*gone, "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalogue.QUERIES), len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
    assert out.split() == ["True", str(len(QUERIES)), "True"]
