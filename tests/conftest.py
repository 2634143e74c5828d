import datetime as dt

import pytest

from checks.session import local_session
from slotcast import schemas


@pytest.fixture(scope="session")
def spark():
    return local_session(memory="4g")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture
def sales(spark):
    """Build a sales frame from rows ``(ds, location, sales type, department, y)``."""

    def build(rows):
        return spark.createDataFrame(rows, schemas.SALES)

    return build


@pytest.fixture
def series(sales):
    """One series of consecutive slots with the given values."""

    def build(values, start=dt.datetime(2024, 1, 1), key=(1, 10, 0), step=15):
        return sales(
            [
                (start + dt.timedelta(minutes=step * i), *key, None if v is None else float(v))
                for i, v in enumerate(values)
            ]
        )

    return build
