import pytest

from tallyfield.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    ship_package(session)
    return session
