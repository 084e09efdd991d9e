import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from spatialqa.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "spatialqa-tests")
