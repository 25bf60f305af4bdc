import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = os.environ.get("GLOSSA_ORACLE_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from glossa.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=8, app_name="glossa-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
