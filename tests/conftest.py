import tempfile

import pytest

from tillview.session import drop_staged, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tillview-tests", tempfile.mkdtemp(prefix="tillview-tests-"))
    yield session
    drop_staged(session)
