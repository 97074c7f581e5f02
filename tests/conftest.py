import glob
import math
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        inner = "/*.parquet" if os.path.isdir(f) else ""
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}{inner}')")
    return con


def plain(v):
    """A value that compares across engines."""
    if v is None or v is math.nan or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not hasattr(v, "dtype"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, str)):
        return str(v)
    try:
        return round(float(v), 5)
    except (TypeError, ValueError):
        return str(v)


def same(got, want):
    """Both pandas frames hold the same rows, in any order."""
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted((tuple(plain(x) for x in r) for r in df[columns].astype(object).itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)
