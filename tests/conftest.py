import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from halyard.session import build

    session = build("local[4]", shuffle_partitions=4, driver_memory="3g", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
