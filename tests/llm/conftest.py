import pytest

from paritas.llm import common


@pytest.fixture(scope="session")
def sp(spark):
    """The test session with the settings the queries use."""
    return common.prepare(spark)
