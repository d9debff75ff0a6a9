import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidegauge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def frame(spark, tmp_path):
    """Frames read from parquet, so that their plan size is known."""
    count = iter(range(1000))

    def make(rows, schema):
        folder = str(tmp_path / f"frame{next(count)}")
        spark.createDataFrame(rows, schema).write.parquet(folder)
        return spark.read.parquet(folder)

    return make


sys.path.insert(0, str(Path(__file__).resolve().parent))
