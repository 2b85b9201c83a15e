"""What is registered, with the optional parts of the repository and without them."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
REPORT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(set(s) - set(q)), 'pipeline' in q, 'term_rank' in q)"


def registered(folder):
    done = subprocess.run([sys.executable, "-c", REPORT], cwd=folder, capture_output=True, text=True, check=True,
                          env={**os.environ, "PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"})
    return done.stdout.split()


@pytest.mark.parametrize("kept", [("corpus_pipeline.py",), ()])
def test_queries_without_the_operators_for_training_text(tmp_path, kept):
    shutil.copytree(os.path.join(ROOT, "textpulse"), tmp_path / "textpulse", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *kept):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    n, unknown, pipeline, core = registered(tmp_path)
    assert int(n) > 80 and unknown == "0" and pipeline == "False" and core == "True"


def test_every_sql_has_a_query():
    assert registered(ROOT)[1] == "0"
