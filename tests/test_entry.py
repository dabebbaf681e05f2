"""The entry module in a process without a session."""

import subprocess
import sys

from conftest import ROOT


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(s) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0
