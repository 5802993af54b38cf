import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from loomspark.session import local_session

    session = local_session(cpus=8, memory="6g", partitions=4)
    yield session
    session.stop()
