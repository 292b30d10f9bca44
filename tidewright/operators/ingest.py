"""Cleaning, deduplication, paging and keyed merges of bars and ticks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOOKBACK_DAYS = 730
ERROR_CHARS = 2000


def floored(ts: Column, seconds: int) -> Column:
    """A timestamp (without zone) floored to the grid of bars, whose step divides a day."""
    into = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) % seconds
    return F.date_trunc("second", ts).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), into)


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by order: a minimum of structs, summed before the shuffle, so a hot key is no large group."""
    rest = [c for c in rows.columns if c not in key]
    lead = [c for c in order if c not in key]
    one = F.min(F.struct(*lead, *(F.col(c) for c in rest if c not in lead))).alias("x")
    return rows.groupBy(*key).agg(one).select(*(F.col(c) if c in key else F.col(f"x.{c}").alias(c) for c in rows.columns))


def first_per_second(ticks: DataFrame) -> DataFrame:
    """Only the first tick of each second of a symbol stays."""
    return first_of(ticks.withColumn("second", F.date_trunc("second", "ts")), ["symbol", "second"], ["seq"]).drop("second")


def latest_ticks(ticks: DataFrame) -> DataFrame:
    """The last tick of each symbol by (ts, seq): a maximum of structs, summed before the shuffle."""
    rest = [c for c in ticks.columns if c not in ("symbol", "ts", "seq")]
    return ticks.groupBy("symbol").agg(F.max(F.struct("ts", "seq", *rest)).alias("x")).select("symbol", "x.*").select(*ticks.columns)


def symbols_like(rows: DataFrame, *parts: str) -> DataFrame:
    """The symbols whose upper-cased name contains any of the parts; all of them where none is given."""
    found = F.lit(not parts)
    for p in parts:
        found = found | F.upper("symbol").contains(p)
    return rows.where(found).select("symbol").distinct()


def naive_utc(seconds: Column) -> Column:
    """Epoch seconds as a UTC time without zone, whatever the session's zone is."""
    return F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def normalised_rates(rates: DataFrame, order: str = "seq", prices: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """symbol, time (without zone), time_utc and prices of broker rates (symbol, time as epoch seconds, order, prices); the first of rows of one time stays."""
    rows = first_of(rates.select("symbol", "time", order, *prices), ["symbol", "time"], [order])
    return rows.select("symbol", naive_utc(F.col("time")).alias("time"), F.timestamp_seconds("time").alias("time_utc"), *prices)


def offset_seconds(broker: Column, utc: Column) -> Column:
    """How far a broker's clock is ahead, rounded to minutes."""
    return (F.round((F.unix_micros(broker.cast("timestamp")) - F.unix_micros(utc.cast("timestamp"))) / 60e6) * 60).cast("int")


def corrected(rows: DataFrame, offset: int | None, columns: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Timestamps less the offset. Without a calibrated offset only an empty table passes."""
    if offset is None:
        if not rows.isEmpty():
            raise ValueError("the broker's clock is not calibrated")
        return rows
    return rows.withColumns({c: F.col(c) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(offset)) for c in columns})


def closed_only(rows: DataFrame, now: Column, seconds: int, ts: str = "ts") -> DataFrame:
    """Bars that began before the grid step that now is in."""
    return rows.where(F.col(ts) < floored(now, seconds))


def newest(rows: DataFrame, n: int) -> DataFrame:
    """The newest n rows, ascending."""
    return rows.orderBy(F.desc("ts"), "symbol").limit(n).orderBy("ts", "symbol")


def increment(rows: DataFrame, last: Column, seconds: int, count: int, overlap: int = 3) -> DataFrame:
    """The oldest `count` rows from `overlap` bars before the last one known, so that a long gap is paged through."""
    back = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(overlap * seconds))
    return rows.where(F.col("ts") >= last - back).orderBy("ts", "symbol").limit(count)


def upserted(base: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """base and batch with one row for each key, the batch's where both have it; a later batch row (by its column seq) wins over an earlier one."""
    rows = base.withColumn("seq", F.lit(-1).cast("long")).unionByName(batch)
    rest = [c for c in base.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("x")).select(*(F.col(c) if c in key else F.col(f"x.{c}").alias(c) for c in base.columns))


def status_merged(status: DataFrame, runs: DataFrame) -> DataFrame:
    """Success sets time and row count and clears the error; failure only sets the error, cut to ERROR_CHARS. runs: (pipeline_name, at, row_count, error)."""
    new = runs.select("pipeline_name", "at", "row_count", F.substring("error", 1, ERROR_CHARS).alias("error"))
    ok = F.col("at").isNotNull() & F.col("error").isNull()
    both = status.join(new, "pipeline_name", "full")
    return both.select(
        "pipeline_name",
        F.when(ok, F.col("at")).otherwise(F.col("last_success_at")).alias("last_success_at"),
        F.when(ok, F.col("row_count")).otherwise(F.col("last_row_count")).alias("last_row_count"),
        F.when(ok, None).otherwise(F.coalesce("error", "last_error")).alias("last_error"),
    )


def lookback_start(as_of: dt.date | Column, days: int = LOOKBACK_DAYS) -> Column:
    return F.date_sub(F.lit(as_of) if isinstance(as_of, dt.date) else as_of, days)


def parsed_time(x: str | dt.datetime) -> dt.datetime:
    """A time with a zone, as UTC; one without raises."""
    x = dt.datetime.fromisoformat(x) if isinstance(x, str) else x
    if not isinstance(x, dt.datetime):
        raise TypeError(f"a time is needed, not {type(x).__name__}")
    if x.tzinfo is None:
        raise ValueError("the time has no zone")
    return x.astimezone(dt.timezone.utc)


def day_ranges(start: dt.datetime, end: dt.datetime, days: int) -> list[tuple[dt.datetime, dt.datetime]]:
    """[start, end) in chunks of so many days: the partitions of a range scan."""
    if not start < end:
        raise ValueError("the range is empty")
    out = []
    while start < end:
        out.append((start, min(start + dt.timedelta(days=days), end)))
        start = out[-1][1]
    return out


def split_60_20_20(bars: DataFrame) -> DataFrame:
    """bars with idx (from 0 in each symbol) and part: train, validation or test."""
    # Positions need an order; counts by symbol are joined rather than windowed over the whole symbol again.
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = bars.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    n = bars.groupBy("symbol").agg(F.count("*").alias("n_bars"))
    cut = lambda share: F.floor(F.col("n_bars") * share)
    return rows.join(n, "symbol").withColumn("part", F.when(F.col("idx") < cut(0.6), "train").when(F.col("idx") < cut(0.8), "validation").otherwise("test")).drop("n_bars")


def as_of(left: DataFrame, right: DataFrame, on: str = "ts", right_on: str = "report_date", value: str = "value", by: list[str] | None = None, block_days: int = 30) -> DataFrame:
    """Each left row with the last right value at or before it.

    Both sides are dealt to blocks of time. Within a block the last value seen
    is carried by one window; what the block begins with is the last value of
    an earlier block, carried over the few rows that blocks make.
    """
    keys, block = by or [], lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (86400 * block_days))
    cols = left.columns
    a = left.select(*cols, F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.col(on).alias("__t"), F.lit(1).alias("__side"))
    b = right.select(*(F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols), F.col(value).alias("__v"), F.col(right_on).cast(left.schema[on].dataType).alias("__t"), F.lit(0).alias("__side"))
    rows = a.unionByName(b).withColumn("__block", block("__t"))
    w = Window.partitionBy(*keys, "__block").orderBy("__t", "__side")
    rows = rows.withColumn("__seen", F.last("__v", ignorenulls=True).over(w))
    heads = rows.groupBy(*keys, "__block").agg(F.max_by("__seen", F.struct("__t", "__side")).alias("__end"))
    heads = heads.withColumn("__begin", F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))
    out = rows.where("__side = 1").join(heads.select(*keys, "__block", "__begin"), [*keys, "__block"], "left")
    return out.select(*cols, F.coalesce("__seen", "__begin").alias(value))
