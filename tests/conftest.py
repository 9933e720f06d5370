import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from gyral.session import local_session, ship

    session = local_session(8, **{"spark.sql.shuffle.partitions": "4"})
    ship(session)
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
