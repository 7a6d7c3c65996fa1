import pytest

from seatflow.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[4]")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Frame from rows and a DDL schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)
