import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("QUILLMILL_TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from quillmill.session import get_session

    s = get_session(4, 8, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
