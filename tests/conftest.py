import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gustline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    settings = {"spark.sql.shuffle.partitions": "8", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="gustline-tests-")}
    session = build_session("tests", "local[8]", **settings)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def values(spark):
    """Evaluate column expressions over one text column."""

    def run(function, *inputs):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, c string")
        return [r[0] for r in rows.orderBy("i").select(function("c")).collect()]

    return run
