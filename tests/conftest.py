import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from textlab.session import build_session, drop_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=4, driver_memory="4g")
    yield s
    drop_scratch(s)
    s.stop()


@pytest.fixture
def docs(spark):
    def make(rows):
        return spark.createDataFrame(rows, "ord bigint, text string")
    return make
