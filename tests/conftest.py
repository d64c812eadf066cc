import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from cartolith.session import build_session

    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions=4, spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def small():
    folder = f"{TESTDATA}/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder
