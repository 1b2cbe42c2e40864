import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import glob

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows_of(frame):
    """Rows as comparable text, columns by name, floats to nine places."""

    def text(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "NULL"
        return repr(round(float(v), 9)) if isinstance(v, float) else str(v)

    names = sorted(frame.columns)
    return names, sorted(tuple(text(r[frame.columns.get_loc(n)]) for n in names) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same():
    def check(left, right):
        assert rows_of(left) == rows_of(right)

    return check
