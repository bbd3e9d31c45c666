"""The entry point without the operators for training data, or without what only they need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("absent", ["zstandard", "public_tokenizers", "corpus_pipeline", "hourloom.llm"])
def test_the_rest_is_there(absent):
    code = (f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; q = e.queries(); "
            "assert 'feature_matrix' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); "
            "assert set(e.oracle_sql()) <= set(q)")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_a_missing_module_of_the_library_is_an_error():
    code = "import sys; sys.modules['hourloom.operators.fill'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode != 0
