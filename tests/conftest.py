import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from edgeweft.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 2)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def small(spark):
    """Eight hyperedges with worked answers, as (e, v)."""
    lines = ["1 2 3", "2 3 4", "3 4 5", "4 5 6", "6 7", "8 9", "8 9 10", "11"]
    return spark.createDataFrame([(e, int(v)) for e, line in enumerate(lines) for v in line.split()], "e bigint, v bigint").cache()
