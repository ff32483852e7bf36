"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from vellumflow.session import get_session

    return get_session(4, "tests", spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def sf():
    return SF
