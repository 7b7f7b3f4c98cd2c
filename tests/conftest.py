from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows_of(df, columns):
    return sorted(map(repr, df[columns].itertuples(index=False, name=None)))


@pytest.fixture(scope="session")
def same(spark, duck, tmp_path_factory):
    """Compares a query with its SQL on the small tables."""

    def check(query, sql: str) -> None:
        path = str(tmp_path_factory.mktemp("out") / "q")
        query(spark, SMALL).write.parquet(path)
        want, got = duck.sql(sql).df(), duck.sql(f"SELECT * FROM '{path}/*.parquet'").df()
        assert sorted(want.columns) == sorted(got.columns)
        columns = sorted(want.columns)
        assert rows_of(got, columns) == rows_of(want, columns)

    return check
