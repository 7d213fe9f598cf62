import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from checkwise.session import build_session, work_dir
    s = build_session(master="local[8]", shuffle_partitions=8)
    work_dir(s)  # sets a private checkpoint folder only when none is configured
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SMALL
