import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from twinline.session import local_session

    session = local_session(8, "tests", spark__driver__memory="8g")
    yield session
    session.stop()
