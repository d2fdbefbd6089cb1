import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from testsieve.session import get_session
    # the production settings, AQE partition coalescing included
    s = get_session("local[4]", app="testsieve-tests", shuffle_partitions=8)
    yield s
    s.stop()
