import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from terrascope.session import get_session
    s = get_session("local[4]", 8, app_name="terrascope-tests")
    yield s
    s.stop()


@pytest.fixture
def tmpdir_run():
    import tempfile
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")
