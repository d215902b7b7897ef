"""One small local session for all tests, and DuckDB over the driver's tables."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "3", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    conf |= {"spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"}
    spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    """A value as comparable text; floats to 6 digits."""
    if isinstance(v, float):
        return f"{v:.6g}"
    if hasattr(v, "asDict"):
        v = list(v.asDict().values())
    elif isinstance(v, dict):
        v = list(v.values())
    return f"[{','.join(map(plain, v))}]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="session")
def same_rows(spark, sf, duck):
    """Asserts that a query and its SQL give the same columns and rows."""

    def check(query, sql):
        df = query(spark, sf)
        columns = sorted(df.columns)
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = sorted([plain(r[names.index(c)]) for c in columns] for r in found.fetchall())
        assert sorted([plain(r[c]) for c in columns] for r in df.collect()) == want

    return check
