import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tools"):
    sys.path.insert(0, str(folder))


@pytest.fixture(scope="session")
def spark():
    from cohortry.session import local_session

    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Build a table from a schema string and row tuples."""

    def build(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return build


def as_set(df):
    return {tuple(r) for r in df.collect()}
