import pytest


@pytest.fixture(autouse=True, scope="session")
def cleaned(spark):
    """What the operators settle goes when the tests have ended."""
    from sparkloom.llm import common

    yield
    common.clean(spark)
    assert not common._MADE
