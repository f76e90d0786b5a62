import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from wayfare.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="wayfare-tests")
    yield s
    s.stop()
