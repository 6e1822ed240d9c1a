import pytest


@pytest.fixture(scope="session")
def mini():
    return "/root/testdata/sf0.01"
