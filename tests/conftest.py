import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledgerlake.session import local_session
    s = local_session("*", 8, app="ledgerlake-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def views_small(spark):
    from ledgerlake.sources.fixtures import ErpViews
    return ErpViews(spark, SMALL)


@pytest.fixture(scope="session")
def views_medium(spark):
    from ledgerlake.sources.fixtures import ErpViews
    return ErpViews(spark, MEDIUM)
