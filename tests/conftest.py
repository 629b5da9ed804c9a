import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from doclake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", partitions=4)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column function applied to one text."""

    def run(function, *texts):
        names = [f"c{i}" for i in range(len(texts))]
        df = spark.createDataFrame([texts], ", ".join(f"{n} string" for n in names))
        return df.select(function(*names).alias("out")).first()["out"]

    return run
