import pytest


@pytest.fixture(scope="session", autouse=True)
def scratch(spark):
    yield
    from cuewright.llm.common import clear_scratch

    clear_scratch(spark)
