"""The library reaches the Python workers of a session that was started elsewhere."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from ledgerlark.session import local_session
spark = local_session(1, "elsewhere")

def work(batches):
    import ledgerlark.schema
    for b in batches:
        yield b.assign(found=ledgerlark.schema.__name__)

print(spark.range(3).mapInPandas(work, "id long, found string").collect()[0].found)
"""


def test_workers_import_the_library_from_another_folder(tmp_path):
    clean = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH",)}
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=180)
    assert run.stdout.strip().endswith("ledgerlark.schema"), run.stderr[-2000:]
