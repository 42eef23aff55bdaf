import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from flowlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
