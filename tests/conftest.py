import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from stationlens.session import drop_written, local_session, scope, work_dir  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    left = [f for _, _, files in os.walk(work_dir(session)) for f in files]
    drop_written(session)
    session.stop()
    assert not left  # scopes have removed everything


@pytest.fixture(autouse=True)
def written_tables(request):
    """Each test owns the tables it writes."""
    if "spark" not in request.fixturenames:
        yield
        return
    with scope(request.getfixturevalue("spark")):
        yield


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck():
    import compare

    return compare.duck(SF_DIR)
