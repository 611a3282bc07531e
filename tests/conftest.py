import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quillstone.session import local_session
    s = local_session("*", shuffle_partitions=8, app="quillstone-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from checks.compare import duck as _duck
    return _duck(SF_SMALL)
