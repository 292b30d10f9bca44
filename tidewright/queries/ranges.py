"""Scans and streams of ranges through the data source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import ranges, store
from .common import Area, r
from .streams import BAR, RAW_BARS

area = Area()
#: Days of a chunk; minutes of a stream's page.
CHUNK_DAYS, PAGE_MINUTES = 7, 5 * 24 * 60


@area.add(f"WITH {RAW_BARS} SELECT symbol, ts, {BAR} FROM b")
def scan_rates(spark, sf_dir):
    """Hourly bars of the whole range, read in chunks of days."""
    ranges.register(spark)
    rows = spark.read.format("rates").options(path=f"{sf_dir}/events.parquet", timeframe="h1", chunk_days=CHUNK_DAYS).load()
    return rows.select("symbol", F.col("time").alias("ts"), *(r(c).alias(c) for c in ("open", "high", "low", "close")), F.col("tick_volume").alias("volume"))


@area.add("SELECT event_type AS symbol, ts, ts - INTERVAL 180 MINUTE AS utc, event_id AS seq, value AS price FROM events")
def scan_ticks(spark, sf_dir):
    """Ticks of the whole range in chunks of days, whose clock is three hours ahead."""
    ranges.register(spark)
    rows = spark.read.format("rates").options(path=f"{sf_dir}/events.parquet", chunk_days=CHUNK_DAYS, offset_minutes=180).load()
    # As a time without zone, whatever the session's zone is.
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_micros("time_utc") / 1e6)
    return rows.select("symbol", F.col("time").alias("ts"), utc.alias("utc"), "seq", "price")


@area.add(f"WITH {RAW_BARS} SELECT symbol, ts, {BAR} FROM b WHERE ts < (SELECT time_bucket(INTERVAL '{PAGE_MINUTES} minutes', max(ts), TIMESTAMP '1970-01-01') FROM events)")
def stream_pages(spark, sf_dir):
    """Hourly bars of a stream that catches up page by page, up to the last page that is over."""
    ranges.register(spark)
    out, state = store.fresh(spark, "pages"), store.fresh(spark, "pages-state")
    progress = state.removeprefix("file://") + "-progress"
    stream = spark.readStream.format("rates").options(path=f"{sf_dir}/events.parquet", timeframe="h1", page_minutes=PAGE_MINUTES, progress=progress).load()
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.read.schema(stream.schema).parquet(out)
    return rows.select("symbol", F.col("time").alias("ts"), *(r(c).alias(c) for c in ("open", "high", "low", "close")), F.col("tick_volume").alias("volume"))


QUERIES, ORACLES = area.queries, area.oracles
