"""Scans, cleaning, merges and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import charts
from ..operators import ingest
from ..operators.ingest import first_of
from ..sources import fixtures as fx
from .common import Area, r, rounded

area = Area()
BAR = "round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume"


def _bars_query(name: str, table: str, step: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fx.bars(spark, sf_dir, step))

    query.__name__ = name
    query.__doc__ = f"Tumbling bars of {step}."
    area.add(f"{fx.with_(table)} SELECT symbol, ts, {BAR} FROM {table}")(query)


_bars_query("bars_ohlc_5m", "bars_5m", "5 minutes")
_bars_query("bars_ohlc_15m", "bars_15m", "15 minutes")
_bars_query("bars_ohlc_1h", "bars_1h", "1 hour")
_bars_query("bars_ohlc_1d", "bars_1d", "1 day")


@area.add(f"{fx.with_('daily')} SELECT symbol, ts, {BAR.replace(', 6)', ', 7)')} FROM daily")
def daily_series(spark, sf_dir):
    """A daily series of orders."""
    return rounded(fx.daily(spark, sf_dir), digits=7)  # steps of 5e-7


@area.add(f"{fx.with_('bars_1h')}, d AS (SELECT symbol, time_bucket(INTERVAL '1 day', ts) AS day, min_by(open, ts) AS open, max(high) AS high, min(low) AS low, max_by(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars_1h GROUP BY 1, 2) SELECT symbol, day AS ts, {BAR} FROM d")
def resample_1h_to_1d(spark, sf_dir):
    """Hourly bars to daily ones."""
    at = F.window("ts", "1 day").getField("start")
    rows = fx.bars(spark, sf_dir).groupBy("symbol", at.alias("ts")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return rounded(rows)


@area.add(f"{fx.with_('bars_1h')} SELECT symbol, ts, {BAR} FROM bars_1h WHERE symbol = 'click' ORDER BY ts")
def load_series(spark, sf_dir):
    """One symbol's whole history, ascending."""
    return rounded(fx.bars(spark, sf_dir).where("symbol = 'click'")).orderBy("ts")


@area.add(f"{fx.with_('bars_1h')} SELECT symbol, ts, {BAR} FROM (SELECT * FROM bars_1h ORDER BY ts DESC, symbol LIMIT 100)")
def scan_recent_bars(spark, sf_dir):
    """The newest hundred bars."""
    return rounded(ingest.newest(fx.bars(spark, sf_dir), 100))


@area.add(f"{fx.with_('bars_1h')} SELECT symbol, max(ts) AS last FROM bars_1h GROUP BY symbol")
def max_bar_time(spark, sf_dir):
    """The last bar of each symbol."""
    return fx.bars(spark, sf_dir).groupBy("symbol").agg(F.max("ts").alias("last"))


@area.add(f"""{fx.with_('bars_1h')}, cut AS (SELECT CAST(TIMESTAMP '2024-01-10 00:00:00' AS TIMESTAMP) AS c),
 rows AS (SELECT b.*, 0 AS seq FROM bars_1h b, cut WHERE ts < c UNION ALL SELECT symbol, ts, open, high, low, close + 1, volume, 1 FROM bars_1h, cut WHERE ts >= c - INTERVAL 3 HOUR),
 kept AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS rn FROM rows)
 SELECT symbol, ts, {BAR} FROM kept WHERE rn = 1""")
def upsert_bars(spark, sf_dir):
    """A batch that overlaps three bars is merged by key; the last write wins."""
    bars, cut = fx.bars(spark, sf_dir), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    batch = bars.where(F.col("ts") >= cut - F.expr("INTERVAL 3 HOURS")).withColumn("close", F.col("close") + 1).withColumn("seq", F.lit(1).cast("long"))
    return rounded(ingest.upserted(bars.where(F.col("ts") < cut), batch, ["symbol", "ts"]))


@area.add("""WITH s(pipeline_name, last_success_at, last_row_count, last_error) AS (VALUES ('a', TIMESTAMP '2024-01-01 00:00:00', 10, NULL), ('b', TIMESTAMP '2024-01-01 00:00:00', 20, 'old'), ('c', TIMESTAMP '2024-01-01 00:00:00', 30, NULL)),
 n(pipeline_name, ended, row_count, error) AS (VALUES ('a', NULL, NULL, 'lost'), ('b', TIMESTAMP '2024-01-02 00:00:00', 25, NULL), ('d', TIMESTAMP '2024-01-02 00:00:00', 5, NULL))
 SELECT coalesce(s.pipeline_name, n.pipeline_name) AS pipeline_name, CASE WHEN n.ended IS NOT NULL AND n.error IS NULL THEN n.ended ELSE s.last_success_at END AS last_success_at,
 CASE WHEN n.ended IS NOT NULL AND n.error IS NULL THEN n.row_count ELSE s.last_row_count END AS last_row_count, CASE WHEN n.ended IS NOT NULL AND n.error IS NULL THEN NULL ELSE coalesce(n.error, s.last_error) END AS last_error
 FROM s FULL JOIN n USING (pipeline_name)""")
def status_upsert(spark, sf_dir):
    """Success and failure of pipelines merged into their status."""
    at = lambda d: f"timestamp_ntz'2024-01-0{d} 00:00:00'"
    status = spark.sql(f"SELECT * FROM VALUES ('a', {at(1)}, 10, CAST(NULL AS STRING)), ('b', {at(1)}, 20, 'old'), ('c', {at(1)}, 30, NULL) AS s(pipeline_name, last_success_at, last_row_count, last_error)")
    runs = spark.sql(f"SELECT * FROM VALUES ('a', CAST(NULL AS TIMESTAMP_NTZ), CAST(NULL AS INT), 'lost'), ('b', {at(2)}, 25, NULL), ('d', {at(2)}, 5, NULL) AS n(pipeline_name, at, row_count, error)")
    return ingest.status_merged(status, runs)


@area.add("SELECT event_type AS symbol, ts, event_id AS seq, value AS price FROM events")
def dedup_keep_first(spark, sf_dir):
    """Ticks delivered twice keep their first copy: a tick is told by its number, so that ticks of one time all stay."""
    ticks = fx.raw_ticks(spark, sf_dir)
    twice = ticks.withColumn("delivery", F.lit(0)).unionByName(ticks.where("seq % 10 = 0").withColumn("delivery", F.lit(1)))
    return first_of(twice, ["symbol", "ts", "seq"], ["delivery"]).drop("delivery")


@area.add("SELECT symbol, ts, seq, price FROM (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, row_number() OVER (PARTITION BY event_type, date_trunc('second', ts) ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def ticks_first_per_second(spark, sf_dir):
    """The first tick of each second."""
    return ingest.first_per_second(fx.raw_ticks(spark, sf_dir))


@area.add(f"{fx.with_('bars_1h')} SELECT symbol, ts, {BAR} FROM (SELECT * FROM bars_1h WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 3 HOUR ORDER BY ts, symbol LIMIT 500)")
def incremental_oldest_n(spark, sf_dir):
    """A gap is paged through from its oldest bars, three bars back."""
    return rounded(ingest.increment(fx.bars(spark, sf_dir), F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), 3600, 500))


@area.add(f"{fx.with_('bars_1h')} SELECT symbol, ts, {BAR} FROM bars_1h WHERE ts < time_bucket(INTERVAL '1 hour', TIMESTAMP '2024-01-20 10:20:30')")
def drop_incomplete(spark, sf_dir):
    """Closed bars alone."""
    return rounded(ingest.closed_only(fx.bars(spark, sf_dir), F.lit("2024-01-20 10:20:30").cast("timestamp_ntz"), 3600))


@area.add("SELECT event_id AS seq, ts - INTERVAL 3 HOUR AS ts, CAST(10800 AS INTEGER) AS offset_s FROM events")
def offset_correct(spark, sf_dir):
    """A broker clock three hours and some seconds ahead, calibrated to minutes and taken off."""
    broker, utc = F.lit("2024-01-01 15:00:14").cast("timestamp_ntz"), F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    rows = fx.raw_ticks(spark, sf_dir).select("seq", "ts").withColumn("offset_s", ingest.offset_seconds(broker, utc))
    return rows.select("seq", (F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("offset_s"))).alias("ts"), "offset_s")


@area.add("SELECT event_id AS seq, time_bucket(INTERVAL '15 minutes', ts) AS m15, time_bucket(INTERVAL '1 hour', ts) AS h1, time_bucket(INTERVAL '1 day', ts) AS d1 FROM events")
def floor_to_grid(spark, sf_dir):
    """Timestamps on the grids of bars."""
    at = lambda s: ingest.floored(F.col("ts"), s)
    return fx.raw_ticks(spark, sf_dir).select("seq", at(900).alias("m15"), at(3600).alias("h1"), at(86400).alias("d1"))


@area.add("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '2001-06-01' - INTERVAL 730 DAY")
def lookback_730d(spark, sf_dir):
    """Orders of the last 730 days."""
    import datetime as dt

    return fx.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").where(F.col("o_orderdate") >= ingest.lookback_start(dt.date(2001, 6, 1)).cast("timestamp_ntz"))


@area.add(f"""{fx.with_('bars_1h')}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n FROM bars_1h)
 SELECT symbol, ts, idx, CASE WHEN idx < floor(n * 0.6) THEN 'train' WHEN idx < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS part FROM n""")
def split_60_20_20(spark, sf_dir):
    """Positional split of each series."""
    return ingest.split_60_20_20(fx.bars(spark, sf_dir)).select("symbol", "ts", "idx", "part")


@area.add(f"""{fx.with_('daily')}, m AS (SELECT date_trunc('month', o_orderdate) AS report_date, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1)
 SELECT d.symbol, d.ts, round(d.close, 7) AS close, round(m.value, 2) AS value FROM daily d ASOF LEFT JOIN m ON d.ts >= m.report_date""")
def asof_monthly_to_daily(spark, sf_dir):
    """The last monthly value at or before each day."""
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    monthly = fx.read(spark, sf_dir, "orders").groupBy(month.alias("report_date")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    rows = ingest.as_of(fx.daily(spark, sf_dir).select("symbol", "ts", "close"), monthly)
    return rows.select("symbol", "ts", r("close", 7).alias("close"), r("value", 2).alias("value"))


@area.add(f"""{fx.with_('bars_1h')} SELECT symbol, ts, round(close, 6) AS close, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS colour, CAST(epoch(ts) AS BIGINT) AS time FROM bars_1h""")
def chart_candles(spark, sf_dir):
    """Candles with their colour and epoch seconds."""
    return fx.bars(spark, sf_dir).select("symbol", "ts", r("close").alias("close"), F.when(F.col("close") >= F.col("open"), "up").otherwise("down").alias("colour"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"))


@area.add(f"{fx.with_('raw_ticks')} SELECT symbol, ts, seq, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS rn FROM raw_ticks) WHERE rn = 1")
def latest_tick(spark, sf_dir):
    """Each symbol's last tick."""
    return ingest.latest_ticks(fx.raw_ticks(spark, sf_dir))


@area.add(f"{fx.with_('raw_ticks')} SELECT DISTINCT symbol FROM raw_ticks WHERE contains(upper(symbol), 'CL') OR contains(upper(symbol), 'UR')")
def symbol_search(spark, sf_dir):
    """Symbols by parts of their names."""
    return ingest.symbols_like(fx.raw_ticks(spark, sf_dir), "CL", "UR")


@area.add(f"""{fx.with_('raw_ticks')}, s AS (SELECT symbol, CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS sec, seq, price FROM raw_ticks), n AS (SELECT *, row_number() OVER (PARTITION BY symbol, sec ORDER BY seq) AS rn FROM s)
 SELECT symbol, make_timestamp(sec * 1000000) AS time, sec AS time_utc, price AS close FROM n WHERE rn = 1""")
def rates_normalise(spark, sf_dir):
    """Broker rates in epoch seconds to times with and without zone, the first of each."""
    minute = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60) * 60
    rates = fx.raw_ticks(spark, sf_dir).select("symbol", minute.alias("time"), "seq", F.col("price").alias("close"))
    return ingest.normalised_rates(rates, prices=("close",)).withColumn("time_utc", F.unix_seconds("time_utc"))


@area.add(f"""{fx.with_('bars_1h')}, n AS (SELECT *, lag(high) OVER w AS hi, lag(low) OVER w AS lo FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY ts)), m AS (SELECT symbol, ts, CAST(epoch(ts) AS BIGINT) AS t, close > hi AS up, close < lo AS down FROM n)
 SELECT symbol, ts, CAST(CASE WHEN up THEN to_json({{'time': t, 'position': 'belowBar', 'color': '#26a69a', 'shape': 'arrowUp', 'text': 'LONG'}}) ELSE to_json({{'time': t, 'position': 'aboveBar', 'color': '#ef5350', 'shape': 'arrowDown', 'text': 'SHORT'}}) END AS VARCHAR) AS marker FROM m WHERE up OR down""")
def chart_markers(spark, sf_dir):
    """JSON markers of bars that close beyond the bar before."""
    w = Window.partitionBy("symbol").orderBy("ts")
    signal = F.when(F.col("close") > F.lag("high").over(w), "long").when(F.col("close") < F.lag("low").over(w), "short")
    rows = fx.bars(spark, sf_dir).withColumn("signal", signal).where("signal is not null")
    return rows.select("symbol", "ts", charts.marker(F.col("ts"), F.col("signal")).alias("marker"))


@area.add(f"""{fx.with_('bars_1h')}, n AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS before, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars_1h)
 SELECT symbol, ts, round(close - before, 6) AS change, round((close - before) / before * 100, 6) AS pct FROM n WHERE rn = 1""")
def latest_change(spark, sf_dir):
    """Each symbol's last bar against the one before."""
    bars = fx.bars(spark, sf_dir)
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    top = bars.select("symbol", "ts", "close", F.row_number().over(w).alias("rn")).where("rn <= 2")  # at most two rows of a symbol leave each task
    rows = top.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("a"), F.min_by("close", "ts").alias("b"))
    return rows.select("symbol", "ts", r(F.col("a") - F.col("b")).alias("change"), r((F.col("a") - F.col("b")) / F.col("b") * 100).alias("pct"))


QUERIES, ORACLES = area.queries, area.oracles
