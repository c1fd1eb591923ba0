import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skein.session import ensure_checkpoint_dir, local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", partitions=4, name="tests")
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
