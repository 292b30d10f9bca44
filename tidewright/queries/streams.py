"""Streams over the event table, each run once over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.kernels import Config
from ..sources import fixtures as fx
from ..sources import days, store
from ..streaming import bars as st
from ..streaming import stateful
from . import recursions as re
from .common import Area, r, rounded
from .rolling import W

area = Area()
BAR = "round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume"
RAW_BARS = "b AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, min_by(value, ts) AS open, max(value) AS high, min(value) AS low, max_by(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"


def _ticks(spark, sf_dir):
    schema = fx.read(spark, sf_dir, "events").schema
    rows = st.files(spark, f"{sf_dir}/events*.parquet", schema)
    return rows.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"))


@area.add(f"WITH {RAW_BARS} SELECT symbol, ts, {BAR} FROM b WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_bars(spark, sf_dir):
    """Closed hourly bars of a stream."""
    return rounded(st.run_available(st.closed_bars(_ticks(spark, sf_dir), "1 hour"), "stream-bars"))


@area.add("SELECT event_type AS symbol, event_id AS seq, value AS price FROM events")
def stream_dedup(spark, sf_dir):
    """Ticks that come twice in a stream, once."""
    ticks = _ticks(spark, sf_dir)
    return st.run_available(st.without_repeats(ticks.unionByName(ticks)).select("symbol", "seq", "price"), "stream-dedup")


@area.add(f"WITH {RAW_BARS} SELECT symbol, ts, {BAR} FROM b")
def stream_upsert(spark, sf_dir):
    """Batches of bars, overlapping, merged into a keyed table as they come."""
    bars = fx.bars_of(fx.raw_ticks(spark, sf_dir), "1 hour")
    folder = store.fresh(spark, "bar-files")
    cut = F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")
    for part in (bars.where(F.col("ts") < cut), bars.where(F.col("ts") >= cut - F.expr("INTERVAL 3 HOURS"))):
        part.coalesce(1).write.mode("append").parquet(folder)
    lease = days.Lease(spark, store.fresh(spark, "bars-lease"))
    lease.acquire()
    table = days.DayTable(spark, store.fresh(spark, "bars"), bars.schema, ["symbol", "ts"], lease)
    stream = st.files(spark, folder, bars.schema, per_trigger=1)
    st.poll(stream, table.merge, store.fresh(spark, "upsert-state"), None).awaitTermination()
    return rounded(table.read())


def in_two_files(spark, bars):
    """A stream of bars that come in two files."""
    folder = store.fresh(spark, "bar-files")
    cut = F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")
    for part in (bars.where(F.col("ts") < cut), bars.where(F.col("ts") >= cut)):
        part.coalesce(1).write.mode("append").parquet(folder)
    return st.files(spark, folder, bars.schema, per_trigger=1)


@area.add(re.KALMAN_OU_SQL)
def stream_filter(spark, sf_dir):
    """The mean filter of each symbol kept as a stream's state."""
    bars = in_two_files(spark, fx.bars(spark, sf_dir).select("symbol", "ts", "close"))
    rows = st.run_available(stateful.online_filter(bars, "ou", Config(window=W, recalibrate=5)), "stream-filter")
    return rows.select("symbol", "ts", r("x", 4).alias("x"), r("sigma_stat", 3).alias("sigma_stat"))


@area.add(re.STRATEGY_OU_SQL)
def stream_signals(spark, sf_dir):
    """Signals of mean reversion as bars come: filter and position are a stream's state."""
    rows = st.run_available(stateful.online_signals(in_two_files(spark, fx.bars(spark, sf_dir)), "ou", Config(**re.RULE)), "stream-signals")
    return rows.select("symbol", "ts", "idx", "signal")


QUERIES, ORACLES = area.queries, area.oracles
