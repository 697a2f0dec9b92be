from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g --conf spark.ui.showConsoleProgress=false pyspark-shell")


@pytest.fixture(scope="session")
def spark():
    from polyomics.session import get_session, prepare

    s = get_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    prepare(s)
    return s


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a Column over literal rows of one column ``x``."""
    from pyspark.sql import functions as F

    def run(column, rows, kind="string"):
        df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
        return [r[1] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
