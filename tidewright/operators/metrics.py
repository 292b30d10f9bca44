"""What trade lists are judged by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profit_factor(x: Column) -> Column:
    """Wins over losses (0 counts as a loss): infinite without losses, null without either."""
    won, lost = F.sum(F.when(x > 0, x)), -F.sum(F.when(x <= 0, x))
    won, lost = F.coalesce(won, F.lit(0.0)), F.coalesce(lost, F.lit(0.0))
    return F.when(lost > 0, won / lost).when(won > 0, F.lit(float("inf")))


def profit_factor_or_zero(x: Column) -> Column:
    """The variant in which 0 is no loss, and neither wins nor losses give 0."""
    won, lost = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.coalesce(-F.sum(F.when(x < 0, x)), F.lit(0.0))
    return F.when(lost > 0, won / lost).when(won > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def curves(trades: DataFrame, by: tuple[str, ...], value: str = "net_pnl", order: str = "trade_no") -> DataFrame:
    """trades with equity, peak and drawdown; the peak begins at the first equity point and not at 0."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("equity", F.sum(value).over(w))
    rows = rows.withColumn("peak", F.max("equity").over(w))
    return rows.withColumn("drawdown", F.col("peak") - F.col("equity"))


def trade_metrics(trades: DataFrame, by: tuple[str, ...], value: str = "net_pnl", order: str = "trade_no", curve: bool = False) -> DataFrame:
    """by, n_trades, win_rate, profit_factor, expectancy, max_drawdown (and the equity curve)."""
    x = F.col(value)
    more = [F.transform(F.array_sort(F.collect_list(F.struct(order, "equity"))), lambda e: e["equity"]).alias("equity_curve")] if curve else []
    return curves(trades, by, value, order).groupBy(*by).agg(F.count("*").alias("n_trades"), (F.sum((x > 0).cast("double")) / F.count("*")).alias("win_rate"), profit_factor(x).alias("profit_factor"), F.avg(x).alias("expectancy"), F.max("drawdown").alias("max_drawdown"), *more)


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, n): equal widths between least and greatest, the last bin closed."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)))
    return x.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def ordinal_ranks(rows: DataFrame, columns: tuple[str, ...], tie: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with rank_<column>: places by value, ties by `tie`. The rows are configurations, at most a grid's size."""
    return rows.withColumns({f"rank_{c}": F.row_number().over(Window.partitionBy(*by).orderBy(c, tie)) for c in columns})


def trades_per_week(n: Column, first: Column, last: Column) -> Column:
    days = F.floor((F.unix_seconds(last.cast("timestamp")) - F.unix_seconds(first.cast("timestamp"))) / 86400)
    return F.when(days > 0, n / days * 7).otherwise(F.lit(0.0))
