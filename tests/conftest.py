import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from usagelens.session import ROCKSDB, local_session

    session = local_session(8)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    yield session
    session.stop()
