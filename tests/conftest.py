import pytest

from touchline.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("8", "tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def limits(spark):
    """Set operator limits for one test."""
    changed = []

    def set_limits(**values):
        from touchline import session

        for name, value in values.items():
            key = getattr(session, name)
            spark.conf.set(key, str(value))
            changed.append(key)

    yield set_limits
    for key in changed:
        spark.conf.unset(key)


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
