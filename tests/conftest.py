from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from shelfloom.session import build_session

    folder = tempfile.mkdtemp(prefix="spark-")
    more = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{folder}/shared",
        "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.default.parallelism": "4",
    }
    session = build_session("local[4]", **more)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
