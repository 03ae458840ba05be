import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strandloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", shuffle=4)
    session.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
