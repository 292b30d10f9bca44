"""Position sizes and the equity they compound to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPITAL, RISK, FLOOR = 10_000.0, 0.01, 0.5


def position_size(equity: Column, sigma: Column, contract: float, risk: float = RISK) -> Column:
    """Contracts that risk a share of the equity for one sigma; 0 where sigma or equity is not positive."""
    return F.when((sigma > 0) & (equity > 0), equity * risk / (sigma * contract)).otherwise(F.lit(0.0))


def simulated(trades: DataFrame, by: tuple[str, ...], contract: float, capital: float = CAPITAL, risk: float = RISK, floor: float = FLOOR) -> DataFrame:
    """by, final_equity, max_drawdown, n_halted and the sizes: trades (trade_no, pnl, sigma) compound in order.

    Once equity is at the floor or under it, each further trade is halted
    (size 0); a trade without a positive sigma has size 0, too, but is not
    halted. A trade list is one fold over its array: it is as long as a
    strategy's trades, not its bars.
    """
    rows = trades.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("trade_no", "pnl", "sigma"))).alias("t"))
    start = F.lit(float(capital))
    zero = F.struct(start.alias("equity"), start.alias("peak"), F.lit(0.0).alias("drawdown"), F.lit(0).cast("long").alias("halted"), F.array().cast("array<double>").alias("sizes"))

    def step(a: Column, t: Column) -> Column:
        halt = a["equity"] <= floor * capital
        size = F.when(halt, F.lit(0.0)).otherwise(position_size(a["equity"], t["sigma"], contract, risk))
        equity = a["equity"] + size * t["pnl"] * contract
        peak = F.greatest(a["peak"], equity)
        return F.struct(equity.alias("equity"), peak.alias("peak"), F.greatest(a["drawdown"], peak - equity).alias("drawdown"), (a["halted"] + halt.cast("long")).alias("halted"), F.concat(a["sizes"], F.array(size)).alias("sizes"))

    out = rows.select(*by, F.aggregate("t", zero, step).alias("r"))
    return out.select(*by, F.col("r.equity").alias("final_equity"), F.col("r.drawdown").alias("max_drawdown"), F.col("r.halted").alias("n_halted"), F.col("r.sizes").alias("sizes"))


def sizing_summary(simulation: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, least, greatest and mean of the positive sizes, and the halted trades."""
    rows = simulation.select(*by, "n_halted", F.explode_outer("sizes").alias("size"))
    own = F.when(F.col("size") > 0, F.col("size"))
    return rows.groupBy(*by).agg(F.min(own).alias("size_min"), F.max(own).alias("size_max"), F.avg(own).alias("size_mean"), F.max("n_halted").alias("n_halted"))
