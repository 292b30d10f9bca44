"""Ordered price series made from the driver's tables, and the same as SQL.

`SQL` holds a common table expression for each; `with_()` chains those that a
query names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scans
from .store import written

#: Cost of a round trip in these series.
COST = 0.12


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, seq, price): a bounded walk of each event type."""
    step = F.col("price").cast("decimal(12,2)") - F.lit(50).cast("decimal(12,2)")
    rows = scans.moving_sum(raw_ticks(spark, sf_dir).withColumn("step", step), "step", 200, "walk", "ts", "seq", ("symbol",))
    return rows.select("symbol", "ts", "seq", (1000 + F.col("walk").cast("double") / 20).alias("price"))


def bars_of(ticks: DataFrame, step: str) -> DataFrame:
    """Tumbling open, high, low, close and volume of (symbol, ts, seq, price)."""
    at, first = F.window("ts", step).getField("start"), F.struct("ts", "seq")
    return ticks.groupBy("symbol", at.alias("ts")).agg(F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", first).alias("close"), F.count("*").alias("volume"))


def bars(spark: SparkSession, sf_dir: str, step: str = "1 hour") -> DataFrame:
    return bars_of(ticks(spark, sf_dir), step)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar a day of a bounded walk over all orders (symbol ORD). Written: days are few, orders are not, and plans read their bars several times."""
    step = F.col("o_totalprice").cast("decimal(14,2)") - F.lit(250000).cast("decimal(14,2)")
    rows = scans.moving_sum(read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), step.alias("step")), "step", 200, "walk", "ts", "seq", block_hours=720)
    px = rows.select("ts", "seq", (1000 + F.col("walk").cast("double") / 20000).alias("price"))
    bars = px.groupBy("ts").agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.count("*").alias("volume"))
    return written(bars.select(F.lit("ORD").alias("symbol"), "*"), "daily")


def _bars_sql(name: str, step: str) -> str:
    return f"{name} AS (SELECT symbol, time_bucket(INTERVAL '{step}', ts) AS ts, min_by(price, ts) AS open, max(price) AS high, min(price) AS low, max_by(price, ts) AS close, count(*) AS volume FROM ticks GROUP BY 1, 2)"


SQL = {
    "raw_ticks": "raw_ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price FROM events)",
    "ticks": "ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, 1000 + CAST(SUM(CAST(value AS DECIMAL(12,2)) - 50) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS DOUBLE) / 20 AS price FROM events)",
    "bars_5m": _bars_sql("bars_5m", "5 minutes"),
    "bars_15m": _bars_sql("bars_15m", "15 minutes"),
    "bars_1h": _bars_sql("bars_1h", "1 hour"),
    "bars_1d": _bars_sql("bars_1d", "1 day"),
    "daily": "daily AS (SELECT 'ORD' AS symbol, ts, min_by(price, seq) AS open, max(price) AS high, min(price) AS low, max_by(price, seq) AS close, count(*) AS volume FROM (SELECT o_orderdate AS ts, o_orderkey AS seq, 1000 + CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2)) - 250000) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS DOUBLE) / 20000 AS price FROM orders) GROUP BY ts)",
}


def with_(*names: str, recursive: bool = False) -> str:
    """WITH and the tables named; bars bring their ticks."""
    need = [n for name in names for n in (["ticks"] if name.startswith("bars_") else []) + [name]]
    return "WITH " + "RECURSIVE " * recursive + ", ".join(SQL[n] for n in dict.fromkeys(need))
