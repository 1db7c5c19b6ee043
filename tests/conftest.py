import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from daybook.session import local_session
    session = local_session(8, "daybook-tests", **{"spark.sql.maxMetadataStringLength": "2000"})
    yield session
    session.stop()
