"""The entry module: names, twins, and a missing dependency of the optional package."""

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_twin_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_survives_a_missing_dependency():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'scan_ranked' in q and not any(n.startswith('p6_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
