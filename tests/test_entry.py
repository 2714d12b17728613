"""The driver contract, and the core without its optional subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent
SMALL = Path("/root/testdata/sf0.001")


def test_names():
    names = entry.queries()
    assert len(names) > 70 and set(entry.oracle_sql()) <= set(names)


def test_core_stands_alone():
    code = "import sys; sys.modules['foliolake.llm'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p5_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


@pytest.mark.skipif(not SMALL.exists(), reason="no test data here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
