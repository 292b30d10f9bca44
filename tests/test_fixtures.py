"""Queries and fixtures on tables with many rows of one time, against DuckDB."""

import duckdb
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from tidewright import queries as library
from tidewright.operators import scans
from tidewright.sources import fixtures as fx


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Events and orders of which several share their times, one time holds hundreds, and others stand alone."""
    sf = str(tmp_path_factory.mktemp("crowded"))
    con = duckdb.connect()
    at = "TIMESTAMP '2024-01-01 00:00:00' + to_hours(CASE WHEN i < 450 THEN 30 WHEN i % 7 = 0 THEN i * 5 ELSE (i % 90) * 8 END)"
    con.sql(f"COPY (SELECT i AS event_id, CAST({at} AS TIMESTAMP) AS ts, i % 11 AS user_id, CASE WHEN i % 5 = 0 THEN 'click' ELSE 'view' END AS event_type, CASE WHEN i % 97 <> 0 THEN (i * 7919 % 10000) / 100.0 END::DOUBLE AS value, '' AS props FROM range(1, 1500) r(i)) TO '{sf}/events.parquet' (FORMAT parquet)")
    con.sql(f"COPY (SELECT i AS o_orderkey, i AS o_custkey, 'O' AS o_orderstatus, CASE WHEN i % 89 <> 0 THEN (i * 104729 % 50000000) / 100.0 END::DOUBLE AS o_totalprice, CAST(date_trunc('day', {at}) AS TIMESTAMP) AS o_orderdate, '' AS o_orderpriority FROM range(1, 1500) r(i)) TO '{sf}/orders.parquet' (FORMAT parquet)")
    for t in ("events", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return sf, con


def test_ticks_of_one_time_are_no_copies(spark, crowded):
    sf, duck = crowded
    same_rows(library.QUERIES["dedup_keep_first"](spark, sf), duck.sql(library.ORACLES["dedup_keep_first"]))


@pytest.mark.parametrize("name", ["daily_series", "fold_bars", "asof_monthly_to_daily"])
def test_daily_walk_of_crowded_days(spark, crowded, name):
    sf, duck = crowded
    same_rows(library.QUERIES[name](spark, sf), duck.sql(library.ORACLES[name]))


def test_tick_walk_of_crowded_hours(spark, crowded):
    sf, duck = crowded
    same_rows(fx.ticks(spark, sf), duck.sql(f"{fx.with_('ticks')} SELECT * FROM ticks"))


@pytest.mark.parametrize("walk", [fx.daily, fx.ticks])
def test_walks_are_in_no_one_order(spark, crowded, walk):
    """No window over rows of a table has a whole series for its partition."""
    plan = walk(spark, crowded[0])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and all("__block" in x for x in plan.splitlines() if "Window" in x and "windowspecdefinition" in x)


@pytest.mark.parametrize("n", [2, 5, 200])
def test_moving_sum(spark, duck, n):
    """Series of few and many rows an hour, null keys, times and values among them."""
    rows = spark.range(3000).selectExpr("CASE WHEN id % 10 < 9 THEN id % 3 END AS k", "CASE WHEN id % 50 > 0 THEN timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, int(CASE WHEN id < 800 THEN 5 ELSE id * id % 977 END)) END AS t", "id", "CASE WHEN id % 13 > 3 THEN CAST(id * 31 % 101 AS DECIMAL(12, 2)) END AS v")
    got = scans.moving_sum(rows, "v", n, "s", "t", "id", ("k",)).select("id", F.col("s").cast("double").alias("s"))
    own = rows.toPandas()
    duck.register("own", own)
    same_rows(got, duck.sql(f"SELECT id, CAST(sum(v) OVER (PARTITION BY k ORDER BY t, id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS DOUBLE) AS s FROM own"))
