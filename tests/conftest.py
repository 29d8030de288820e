import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cutlight.session import local_session

    s = local_session("4", **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "2"})
    yield s
    s.stop()


@pytest.fixture
def table(spark):
    """table("a int, b string", (1, "x"), ...) -> DataFrame"""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
