import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidewatt.session import get_session
    s = get_session("local[4]", 8, app_name="tidewatt-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="tidewatt-test-")
