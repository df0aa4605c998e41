import pytest


@pytest.fixture(scope="session")
def sf_llm():
    return "/root/testdata/sf0.001"
