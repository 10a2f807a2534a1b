import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def same_rows(frame, relation) -> bool:
    """Whether a DataFrame and a DuckDB result hold the same rows, whatever their order."""
    cols = sorted(frame.columns)
    mine = sorted((tuple(r[c] for c in cols) for r in frame.collect()), key=str)
    other = relation.df()
    assert sorted(other.columns) == cols
    theirs = sorted(map(tuple, other[cols].astype(object).where(other[cols].notna(), None).values.tolist()), key=str)
    return mine == theirs
