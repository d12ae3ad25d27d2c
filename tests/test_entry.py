"""The entry without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(setup):
    code = f"import sys\nsys.path.insert(0, {str(ROOT)!r})\n{setup}\nimport __spark_entry__ as e\nprint('|'.join(e.queries()), len(e.oracle_sql()))"
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout


def test_llm_that_cannot_be_imported():
    assert "op1_" not in names("sys.modules['verdigraph.llm'] = None") and "answer_groups" in names("sys.modules['verdigraph.llm'] = None")
    assert "pipeline" not in names("sys.modules['corpus_pipeline'] = None")
