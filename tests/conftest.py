import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in [sys.path[0], os.environ.get("PYTHONPATH", "")] if p)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same(got, expected):
    """Equal rows, whatever their order; doubles to nine digits."""
    assert sorted(got.columns) == sorted(expected.columns)
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = lambda d: sorted(tuple(map(cell, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(expected)
