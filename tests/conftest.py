import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from claimlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    # The tests run many small plans once each, so compiling them well does not pay.
    quick = {"spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1", "spark.sql.codegen.wholeStage": "false"}
    session = local_session(cores=8, shuffle_partitions=2, more=quick)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Collect a frame as a list of tuples in a stable order."""

    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
