"""The driver's contract, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_stands_alone(tmp_path):
    """Without the corpus folders the entry still imports, and nothing else in the library misses them."""
    for x in ("chronoloom", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{REPO}/{x}") else shutil.copy)(f"{REPO}/{x}", tmp_path / x)
    shutil.rmtree(tmp_path / "chronoloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(k.startswith('op1_') or k == 'pipeline' for k in q); print('fine')"
    r = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert r.stdout.strip() == "fine", r.stderr
