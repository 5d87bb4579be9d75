import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from stayscope.session import build_session

    session = build_session("stayscope-tests", "local[8]")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def workspace(spark, folder):
    from stayscope.plans.workspace import Workspace

    return Workspace.open(spark, folder)
