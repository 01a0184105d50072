from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from memgrid.session import make_session

    s = make_session("tests", master="local[4]", shuffle_partitions=4, memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
