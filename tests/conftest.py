import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for p in (ROOT, os.path.join(ROOT, "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.runtime import local_session, ship

    s = local_session(int(os.environ.get("TEST_CPUS", "8")), spark__sql__shuffle__partitions="4")
    ship(s)
    yield s
    s.stop()
