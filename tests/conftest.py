import os
import sys

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ.get("PYTHONPATH", "")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Rows of SQL over a folder of tables, as a sorted list of tuples with the column names."""
    import duckdb

    def rows(sql: str, folder: str = TINY):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for f in os.listdir(folder):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
        return canonical(con.execute(sql).df())

    return rows


def canonical(frame):
    """Column names, and rows as sorted text: floats to nine places, missing values alike."""
    names = sorted(frame.columns)

    def text(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        if hasattr(v, "tolist"):
            v = v.tolist()
        return repr(round(v, 9) if isinstance(v, float) else v)

    return names, sorted(tuple(map(text, r)) for r in frame[names].astype(object).itertuples(index=False))
