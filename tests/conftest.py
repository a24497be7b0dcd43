import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("TZ", "UTC")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.host", "127.0.0.1").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def normal(rows):
    """Rows as sorted tuples of text; numbers to nine digits."""

    def text(x):
        if isinstance(x, float):
            return "%.9g" % x
        if isinstance(x, (list, tuple)):
            return str([text(y) for y in x])
        return str(x)

    return sorted(tuple(text(x) for x in r) for r in rows)


def same_as_sql(spark, duck, query, sql, sf_dir):
    import duckdb

    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = normal(tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    want = duck.sql(sql)
    assert sorted(want.columns) == cols
    assert got == normal(want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
