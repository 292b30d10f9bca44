"""Round trips from signals: entries and exits alternate, so the next event of a series closes its entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trades(events: DataFrame, by: tuple[str, ...] = ("symbol",), cost: float = 0.0) -> DataFrame:
    """by, trade_no (from 0), side, entry_idx, exit_idx, entry_ts, exit_ts, entry_close, exit_close, pnl, net_pnl.

    events: by, ts, idx, close, signal. An entry still open at the end of its
    series is no trade; the cost is taken once for a round trip.
    """
    w = Window.partitionBy(*by).orderBy("idx")
    rows = events.where(F.col("signal").isNotNull())
    rows = rows.select(*by, "idx", "ts", "close", "signal", F.lead("idx").over(w).alias("exit_idx"), F.lead("ts").over(w).alias("exit_ts"), F.lead("close").over(w).alias("exit_close"))
    rows = rows.where(F.col("signal").isin("long", "short") & F.col("exit_idx").isNotNull())
    pnl = (F.col("exit_close") - F.col("close")) * F.when(F.col("signal") == "long", 1.0).otherwise(-1.0)
    return rows.select(
        *by, (F.row_number().over(w) - 1).cast("long").alias("trade_no"), F.col("signal").alias("side"), F.col("idx").alias("entry_idx"), "exit_idx",
        F.col("ts").alias("entry_ts"), "exit_ts", F.col("close").alias("entry_close"), "exit_close", pnl.alias("pnl"), (pnl - cost).alias("net_pnl"),
    )


def channel_events(bars: DataFrame, n: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A long-only channel breakout in window functions alone: long above the highest, out below the lowest of n closes before.

    Between two bars that break out downwards only the first break upwards is
    an entry: the state is the last break, so entries and exits are where it
    changes.
    """
    w, prior = Window.partitionBy(*by).orderBy("ts"), Window.partitionBy(*by).orderBy("ts").rowsBetween(-n, -1)
    full = F.count("close").over(prior) == n
    state = F.when(full & (F.col("close") > F.max("close").over(prior)), 1).when(full & (F.col("close") < F.min("close").over(prior)), 0)
    rows = bars.select(*by, "ts", (F.row_number().over(w) - 1).cast("long").alias("idx"), "close", state.alias("broke"))
    rows = rows.withColumn("state", F.coalesce(F.last("broke", ignorenulls=True).over(w), F.lit(0)))
    rows = rows.withColumn("before", F.coalesce(F.lag("state").over(w), F.lit(0)))
    signal = F.when((F.col("state") == 1) & (F.col("before") == 0), "long").when((F.col("state") == 0) & (F.col("before") == 1), "close_long")
    return rows.select(*by, "ts", "idx", "close", signal.alias("signal"))
