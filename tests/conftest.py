import os

import pytest

from fieldmarch.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(os.cpu_count() or 4, 4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
