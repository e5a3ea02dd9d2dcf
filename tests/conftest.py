from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return repr(round(v, 4))
    return str(v)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compare a query with its SQL on the smallest tables, as multisets of rows."""

    def check(query, sql):
        ours, ref = query(spark, SF).toPandas(), duck.sql(sql).df()
        columns = sorted(ours.columns)
        assert columns == sorted(ref.columns)
        rows = [sorted(tuple(map(_plain, r)) for r in x[columns].itertuples(index=False)) for x in (ours, ref)]
        assert rows[0] == rows[1]

    return check
