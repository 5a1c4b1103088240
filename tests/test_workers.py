"""Python tasks must run on workers that cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parent.parent)
SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as entry
from panelcast.session import build_session
spark = build_session("workers", "2")
for name in ("linear_forecast", "elasticnet_forecast", "knn_impute"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
spark.stop()
print("done")
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert run.returncode == 0 and "done" in run.stdout, run.stderr[-3000:]
