import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v) -> str:
    if v is None or v != v:
        return "NULL"
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


def same_rows(df, relation) -> None:
    cols = sorted(df.columns)
    assert sorted(relation.columns) == cols
    at = [relation.columns.index(c) for c in cols]
    ours = sorted(tuple(plain(row[c]) for c in cols) for row in df.collect())
    theirs = sorted(tuple(plain(row[i]) for i in at) for row in relation.fetchall())
    assert ours == theirs
