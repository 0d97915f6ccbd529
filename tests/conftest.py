import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from runlens.session import local_session

    session = local_session("tests", cores="8", shuffle_partitions=4)
    yield session


@pytest.fixture(scope="session")
def rows(spark):
    """rows(ddl, [tuples]) -> DataFrame."""
    return lambda ddl, data: spark.createDataFrame(data, ddl)
