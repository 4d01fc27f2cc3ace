import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rowassay.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "rowassay-tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
