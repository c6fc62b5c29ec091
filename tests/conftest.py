import pytest

from docmill.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", spark__driver__memory="4g", spark__sql__shuffle__partitions="4")
