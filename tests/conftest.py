import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYTHONPATH", str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from cragline.session import local_session, ship

    session = local_session(cpus=int(os.environ.get("TEST_CPUS", "4")), memory="3g", shuffle_partitions=4)
    ship(session)
    yield session
    session.stop()
