import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from boxtrail.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Send nearly every key down the distributed routes."""
    names = {"boxtrail.hot.foldRows": "2", "boxtrail.hot.windowRows": "3"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k in names:
        spark.conf.unset(k)
