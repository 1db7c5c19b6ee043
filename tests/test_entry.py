"""The contract's module where parts of the package can't be imported."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["xxhash", "daybook.llm", "corpus_pipeline"])
def test_sales_queries_stay_without(missing):
    code = (f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; "
            "assert 'leaderboard' in e.queries() and 'leaderboard' in e.oracle_sql(); assert 'op1_sharding' not in e.queries()")
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, timeout=120)
