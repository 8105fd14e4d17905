import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from vellum.session import local_session
    s = local_session(4, shuffle_partitions=4, app="vellum-tests",
                      extra={"spark.sql.session.timeZone": "UTC"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf001():
    return "/root/testdata/sf0.001"
