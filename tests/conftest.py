import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["TZ"] = "UTC"


@pytest.fixture(scope="session")
def spark():
    from quarrymark.session import local_session, ship

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def one(spark):
    """Evaluates columns over literal inputs: one(f, a, b, ...) gives f's value for each input."""
    from pyspark.sql import functions as F

    def run(f, *values):
        kind = "double" if isinstance(next((v for v in values if v is not None), None), float) else "string"
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r["out"] for r in df.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]

    return run
