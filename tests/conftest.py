import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """Run SQL over the Parquet tables of a folder."""
    import duckdb

    def run(sql: str, sf_dir: str):
        con = duckdb.connect()
        for name in os.listdir(sf_dir):
            con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
        out = con.sql(sql)
        return out.columns, out.fetchall()

    return run


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Check that a query and its SQL give equal rows."""

    def plain(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f"{float(v):.9g}"
        return str(v)

    def check(query, sql, sf_dir="/root/testdata/sf0.001"):
        df = query(spark, sf_dir)
        columns, rows = duck(sql, sf_dir)
        assert sorted(df.columns) == sorted(columns)
        order = sorted(columns)
        got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
        want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in rows)
        assert got == want

    return check
