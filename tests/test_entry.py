"""The entry module imports without a session, and every oracle belongs to a query."""

import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parent.parent


def test_import_without_a_session():
    told = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q), set(o) - set(q); print(len(q))"
    run = subprocess.run([sys.executable, "-c", told], cwd=TOP, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0 and int(run.stdout.split()[-1]) >= 150, run.stderr[-1000:]
