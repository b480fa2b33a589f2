import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from evalspark.session import build_session, checkpoint_root  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, app_name="evalspark-tests")
    checkpoint_root(s)      # the configured shared folder, or a private one in local mode
    yield s
    s.stop()
