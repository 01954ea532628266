import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.streaming.schemaInference": "false",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def comparable(frame):
    """Rows as sorted tuples of text, columns by name, doubles to 12 digits."""
    columns = sorted(frame.columns)
    text = lambda v: "NULL" if v is None or v is pd.NA or v != v else ("%.12g" % v if isinstance(v, float) else str(v))
    rows = frame[columns].astype(object).itertuples(index=False, name=None)
    return columns, sorted(tuple(text(v) for v in r) for r in rows)


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    def check(query, sql):
        assert comparable(query(spark, sf_dir).toPandas()) == comparable(duck.sql(sql).df())

    return check
