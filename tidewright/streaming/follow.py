"""From an empty target to a stream that keeps it up to date.

The history up to the last page that is over is filled in as one batch, read
in chunks of days; the stream begins where that ends, so nothing is missing
and nothing comes twice. A target that has rows is not filled again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ranges
from ..sources.days import DayTable
from .bars import poll

#: Batch number of the history; a stream's own are shifted by one.
HISTORY = 0
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"


def bars_of(rates: DataFrame) -> DataFrame:
    return rates.select("symbol", F.col("time").alias("ts"), "open", "high", "low", "close", F.col("tick_volume").alias("volume"))


def bootstrap(spark: SparkSession, table: DayTable, options: dict[str, str]) -> dt.datetime | None:
    """Fills an empty table with all pages that are over; where the stream goes on, as broker time, or None for a source without rows."""
    ranges.register(spark)
    reader = ranges.PageReader(options)
    spans = reader.table.spans().values()
    if not spans:
        return None
    until = reader.floor(max(b for _, b in spans))
    if table.state()["batch"] is None:
        kept = {k: v for k, v in options.items() if k not in ("progress", "page_minutes", "overlap_minutes")}
        end = (until - reader.table.offset).replace(tzinfo=dt.timezone.utc).isoformat()
        table.merge(bars_of(spark.read.format("rates").options(**kept, end=end).load()), HISTORY)
    return until


def follow(spark: SparkSession, table: DayTable, options: dict[str, str], state: str, seconds: int | None = 60):
    """Bootstrap, then a stream of pages merged into the table; the stream's query.

    options: those of the range source, with a timeframe, page_minutes and
    progress; state: the checkpoint's folder. After a restart the checkpoint
    says where the stream goes on, whatever the source has by then.
    """
    until = bootstrap(spark, table, options)
    begin = {} if until is None else {"begin": until.isoformat()}
    stream = bars_of(spark.readStream.format("rates").options(**options, **begin).load())
    return poll(stream, lambda batch, n: table.merge(batch, HISTORY + 1 + n), state, seconds)
