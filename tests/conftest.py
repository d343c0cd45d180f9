import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def rows(df, *cols):
    """The rows of a DataFrame as a sorted list of tuples."""
    got = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(got, key=lambda t: tuple((x is None, str(x)) for x in t))


def normal(pdf):
    import pandas as pd

    pdf = pdf[sorted(pdf.columns)]
    out = []
    for r in pdf.itertuples(index=False):
        out.append(tuple("" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else format(float(v), ".6g") if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in r))
    return sorted(out)


def agrees(spark, duck, function, sql):
    a, b = function(spark, DATA).toPandas(), duck.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert normal(a) == normal(b)
