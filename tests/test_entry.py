"""The registry without its optional part: a copy of the repository that lacks the text operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


@pytest.mark.parametrize("without", ["folders", "library"])
def test_other_queries_need_no_text_operators(tmp_path, without):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n == ".git" or n == "__pycache__" or (without == "folders" and n == "llm")])
    blocked = "" if without == "folders" else "import sys; sys.modules['tiktoken'] = None; "
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", blocked + COUNT], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    queries, oracles, text = run.stdout.split()
    assert int(queries) > 170 and int(oracles) > 150 and text == "False"
