import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

DATA = os.environ.get("LAKELOOM_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lakeloom.session import get_session

    s = get_session("tests", cores=4, shuffle_partitions=4, **{"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(scope="session")
def oracle(sf):
    from compare import connect

    return connect(sf)
