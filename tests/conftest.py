import pytest

from millrace.session import session


@pytest.fixture(scope="session")
def spark():
    return session(cpus="4", spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
