import pytest

from pairwise.session import local_session, via_table
from pairwise.sources import contests

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def matches(spark):
    return via_table(contests.matches(spark, FOLDER), "test-matches")


@pytest.fixture(scope="session")
def few(spark, matches):
    """The earliest contests: small enough for the wave-by-wave forms."""
    first = matches.orderBy("match_date").limit(60)
    return via_table(first, "test-few")
