import os
import sys
import tempfile

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from concord.session import local_session  # noqa: E402

DATA = os.environ.get("CONCORD_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=4, **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="concord-test-")})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA
