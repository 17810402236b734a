"""The driver contract with and without the training-data operators."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
LIST = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, pipeline):
    whole = [set(x) for x in json.loads(subprocess.run([sys.executable, "-c", LIST], cwd=REPO, capture_output=True, text=True, check=True).stdout)]
    copy = tmp_path / "copy"
    shutil.copytree(REPO / "pitgauge", copy / "pitgauge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", copy)
    if pipeline and (REPO / "corpus_pipeline.py").exists():
        shutil.copy(REPO / "corpus_pipeline.py", copy)
    left = [set(x) for x in json.loads(subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, check=True).stdout)]
    assert left[0] == {q for q in whole[0] if not q.startswith("op") or not q[2:3].isdigit()} - {"pipeline"}
    assert len(left[0]) > 150 and left[1] <= whole[1] and left[1] <= left[0]
