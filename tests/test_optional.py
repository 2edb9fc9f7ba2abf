"""The library without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(e.llm, e.corpus_pipeline, sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"


@pytest.mark.parametrize("left", [[], ["corpus_pipeline.py"]])
def test_entry_without_text_operators(tmp_path, left):
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", *({"corpus_pipeline.py"} - set(left)))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=gone)
    said = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    llm, pipeline, checked, count = said.stdout.split()
    assert (llm, pipeline, checked) == ("None", "None", "True") and int(count) > 30
