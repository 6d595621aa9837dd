import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from check_oracle import connect, local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def con():
    return connect(SF)


@pytest.fixture(scope="session")
def ev(spark):
    """Evaluate a Column function on one text."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        cols = [F.col(f"c{i}") for i in range(len(values))]
        names = [f"c{i}" for i in range(len(values))]
        return spark.createDataFrame([values], names).select(fn(*cols).alias("x")).first()["x"]

    return run


@pytest.fixture(scope="session")
def feats(ev):
    """Evaluate a feature family on one text, as a dict."""
    return lambda fn, text: {r["feature"]: r["value"] for r in ev(fn, text)}
