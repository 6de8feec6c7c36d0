"""The entry module where the corpus operators are not there."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import __spark_entry__ as entry
queries, oracles = entry.queries(), entry.oracle_sql()
assert "next_track_top10" in queries and "pipeline" not in queries
assert not any(name.startswith("op") and name[2].isdigit() for name in (*queries, *oracles))
assert set(oracles) <= set(queries) and callable(entry.entry)
"""


@pytest.mark.parametrize("left", [[], ["corpus_pipeline.py"]])
def test_without_corpus_operators(tmp_path, left):
    for name in ["__spark_entry__.py", *[n for n in left if (ROOT / n).exists()]]:
        shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "sonolith", tmp_path / "sonolith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
