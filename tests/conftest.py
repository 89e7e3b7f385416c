import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# message services are found by module name in the Python processes Spark starts
os.environ["POLLED_SIZES"] = os.path.join(tempfile.mkdtemp(prefix="polled-"), "sizes.json")
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

from lorebase.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate a column function on single string arguments, one row per call."""
    from pyspark.sql import functions as F

    def run(function, *values):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "i INT, v STRING")
        return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]

    return run
