import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from claimloom.session import get_spark  # noqa: E402
from oracle import duck, sf_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def path():
    return sf_dir("0.001")


@pytest.fixture(scope="session")
def con(path):
    return duck(path)
