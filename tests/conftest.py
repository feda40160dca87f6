import os

import pytest

from codeloom.session import local_session, ship_package

DATA = os.environ.get("CODELOOM_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA


def rows(df):
    """Rows as a sorted list of tuples; nulls first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is not None, str(v)) for v in t))
