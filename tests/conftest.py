import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pageloom.session import local_session
    session = local_session("tests", cpus=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER
