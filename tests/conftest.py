import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent))

from layerscan.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "layerscan-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
