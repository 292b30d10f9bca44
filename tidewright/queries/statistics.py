"""Trade metrics, Sharpe significance, resampling and sizing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import moments as mo
from ..functions import normal
from ..operators import metrics, resample, sizing
from ..operators import rolling as ro
from ..sources import fixtures as fx
from .common import Area, r, rounded
from .recursions import TRADES, channel_trades, hourly

area = Area()
PF = "CASE WHEN coalesce(-sum(net_pnl) FILTER (WHERE net_pnl <= 0), 0) > 0 THEN coalesce(sum(net_pnl) FILTER (WHERE net_pnl > 0), 0) / -sum(net_pnl) FILTER (WHERE net_pnl <= 0) WHEN coalesce(sum(net_pnl) FILTER (WHERE net_pnl > 0), 0) > 0 THEN CAST('inf' AS DOUBLE) END"
EQUITY = f"{TRADES}, q AS (SELECT *, sum(net_pnl) OVER (PARTITION BY symbol ORDER BY trade_no) AS equity FROM t), k AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY trade_no) AS peak FROM q)"


@area.add(f"{EQUITY} SELECT symbol, count(*) AS n_trades, round(avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round({PF}, 6) AS profit_factor, round(avg(net_pnl), 6) AS expectancy, round(max(peak - equity), 6) AS max_drawdown FROM k GROUP BY symbol")
def trade_metrics(spark, sf_dir):
    """Win rate, profit factor, expectancy and drawdown of each symbol."""
    return rounded(metrics.trade_metrics(channel_trades(spark, sf_dir), ("symbol",)))


@area.add(f"{EQUITY} SELECT symbol, CAST(trade_no AS BIGINT) AS trade_no, round(equity, 6) AS equity, round(peak - equity, 6) AS drawdown FROM k")
def drawdown_curve(spark, sf_dir):
    """Equity and drawdown after each trade."""
    return rounded(metrics.curves(channel_trades(spark, sf_dir), ("symbol",)).select("symbol", "trade_no", "equity", "drawdown"))


@area.add(f"{TRADES} SELECT symbol, round(CASE WHEN coalesce(-sum(net_pnl) FILTER (WHERE net_pnl < 0), 0) > 0 THEN coalesce(sum(net_pnl) FILTER (WHERE net_pnl > 0), 0) / -sum(net_pnl) FILTER (WHERE net_pnl < 0) WHEN sum(net_pnl) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END, 6) AS pf, round(least(coalesce({PF}, 0), 5), 6) AS pf_capped FROM t GROUP BY symbol")
def profit_factor(spark, sf_dir):
    """The other profit factor, and the capped one of charts."""
    x = F.col("net_pnl")
    return rounded(channel_trades(spark, sf_dir).groupBy("symbol").agg(metrics.profit_factor_or_zero(x).alias("pf"), F.least(F.coalesce(metrics.profit_factor(x), F.lit(0.0)), F.lit(5.0)).alias("pf_capped")))


RETURNS = f"{fx.with_('bars_1h')}, ret AS (SELECT symbol, ts, round(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts), 4) AS ret FROM bars_1h QUALIFY ret IS NOT NULL)"


def returns(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    return rows.select("symbol", "ts", F.round(F.col("close") - ro.previous(F.col("close")), 4).alias("ret")).where("ret is not null")


@area.add(f"{RETURNS} SELECT symbol, count(*) AS n, round(avg(ret) / stddev_samp(ret), 6) AS sharpe, round(skewness(ret), 5) AS skew, round(kurtosis(ret) + 3, 5) AS kurtosis FROM ret GROUP BY symbol")
def sharpe_skew_kurt(spark, sf_dir):
    """Sharpe ratio and bias-corrected moments."""
    rows = mo.moments(returns(spark, sf_dir), ["symbol"])
    return rows.select("symbol", "n", r("sharpe").alias("sharpe"), r("skew", 5).alias("skew"), r("kurtosis", 5).alias("kurtosis"))


def _psr(sr: str, star: str) -> str:
    return normal.phi_sql(f"(({sr} - {star}) * sqrt(n - 1) / sqrt(greatest(1 - skew * {sr} + (kurt - 1) / 4 * {sr} * {sr}, 1e-12)))")


@area.add(f"""{RETURNS}, m AS (SELECT symbol, count(*) AS n, avg(ret) / stddev_samp(ret) AS sr, skewness(ret) AS skew, kurtosis(ret) + 3 AS kurt FROM ret GROUP BY symbol),
 s AS (SELECT *, sqrt(0.0004) * ((1 - {normal.EULER}) * ({normal.phi_inverse_sql('(1 - 1 / 64.0)')}) + {normal.EULER} * ({normal.phi_inverse_sql('(1 - 1 / (64.0 * exp(1)))')})) AS sr0 FROM m)
 SELECT symbol, round(sr0, 5) AS sr0, round({_psr('sr', '0')}, 5) AS psr_vs_zero, round({_psr('sr', 'sr0')}, 5) AS dsr FROM s""")
def psr_dsr(spark, sf_dir):
    """Probabilistic and deflated Sharpe ratio for 64 trials."""
    rows = mo.deflated(mo.moments(returns(spark, sf_dir), ["symbol"]), F.lit(64.0), F.lit(0.0004))
    return rows.select("symbol", r("sr0", 5).alias("sr0"), r("psr_vs_zero", 5).alias("psr_vs_zero"), r("dsr", 5).alias("dsr"))


@area.add(f"{RETURNS}, e AS (SELECT min(ret) AS lo, max(ret) AS hi FROM ret) SELECT CAST(least(floor((ret - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM ret, e GROUP BY 1")
def hist20(spark, sf_dir):
    """Returns in twenty bins."""
    return metrics.histogram(returns(spark, sf_dir), "ret")


@area.add(f"""{TRADES}, n AS (SELECT symbol, count(*) AS n, avg(net_pnl) AS mean FROM t GROUP BY symbol), dr AS (SELECT t.symbol, b.b, ({resample.draw_sql('b.b', 't.trade_no')}) % n.n AS pick FROM t JOIN n USING (symbol), range({resample.BOOTSTRAP_RUNS}) b(b)),
 m AS (SELECT dr.symbol, dr.b, avg(t.net_pnl) AS m FROM dr JOIN t ON dr.symbol = t.symbol AND dr.pick = t.trade_no GROUP BY 1, 2), o AS (SELECT symbol, quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) AS p_positive FROM m GROUP BY symbol)
 SELECT symbol, n, round(mean, 6) AS mean, round(lower, 6) AS lower, round(upper, 6) AS upper, round(p_positive, 6) AS p_positive FROM n JOIN o USING (symbol)""")
def bootstrap_ci(spark, sf_dir):
    """Interval of the mean trade."""
    return rounded(resample.bootstrap(channel_trades(spark, sf_dir).select("symbol", "trade_no", "net_pnl"), ("symbol",), resample.BOOTSTRAP_RUNS))


@area.add(f"""{TRADES}, bars AS (SELECT symbol, idx, close FROM d), n AS (SELECT symbol, count(*) AS n, sum(net_pnl) AS real FROM t GROUP BY symbol), nb AS (SELECT symbol, count(*) AS n_bars FROM bars GROUP BY symbol),
 a AS (SELECT t.symbol, b.b, t.trade_no AS i, n.n, nb.n_bars, ({resample.draw_sql('b.b', 't.trade_no')}) % n.n AS pick FROM t JOIN n USING (symbol) JOIN nb USING (symbol), range({resample.SIMULATIONS}) b(b)),
 c AS (SELECT a.*, least(greatest(t.exit_idx - t.entry_idx, 1), n_bars - 1) AS span FROM a JOIN t ON a.symbol = t.symbol AND a.pick = t.trade_no),
 e AS (SELECT *, ({resample.draw_sql('b', 'i', resample.ENTRY)}) % (n_bars - span) AS entry, CASE WHEN ({resample.draw_sql('b', 'i', resample.WAY)}) >= {resample.MODULUS // 2} THEN 1.0 ELSE -1.0 END AS way FROM c),
 sims AS (SELECT e.symbol, e.b, sum(way * (y.close - x.close) - {fx.COST}) AS total FROM e JOIN bars x ON x.symbol = e.symbol AND x.idx = e.entry JOIN bars y ON y.symbol = e.symbol AND y.idx = e.entry + e.span GROUP BY 1, 2)
 SELECT sims.symbol, round(max(real), 7) AS real, round(avg(CASE WHEN total < real THEN 1.0 ELSE 0.0 END), 6) AS percentile, round(avg(total), 7) AS sim_mean, round(stddev_pop(total), 7) AS sim_std, round(quantile_cont(total, 0.05), 7) AS sim_p05, round(quantile_cont(total, 0.95), 7) AS sim_p95 FROM sims JOIN n USING (symbol) GROUP BY sims.symbol""")
def monte_carlo_baseline(spark, sf_dir):
    """The channel breakout against random entries."""
    w = Window.partitionBy("symbol").orderBy("ts")
    bars = hourly(spark, sf_dir).select("symbol", (F.row_number().over(w) - 1).cast("long").alias("idx"), "close")
    rows = resample.monte_carlo(channel_trades(spark, sf_dir).select("symbol", "trade_no", "entry_idx", "exit_idx", "net_pnl"), bars, ("symbol",), resample.SIMULATIONS, fx.COST)
    return rounded(rows, "percentile", digits=7).withColumn("percentile", r("percentile"))


def sized(spark, sf_dir):
    vol = hourly(spark, sf_dir).select("symbol", F.col("ts").alias("entry_ts"), ro.volatility(F.col("close")).alias("sigma"))
    rows = channel_trades(spark, sf_dir).select("symbol", "trade_no", "entry_ts", F.col("net_pnl").alias("pnl"))
    return rows.join(vol, ["symbol", "entry_ts"]).select("symbol", "trade_no", "pnl", "sigma")


SIZED = f"""{TRADES.replace('WITH ', 'WITH RECURSIVE ', 1)}, v AS (SELECT symbol, ts, CASE WHEN count(*) OVER p = 20 THEN stddev_samp(close) OVER p END AS sigma FROM bars_1h WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
 g AS (SELECT t.symbol, trade_no, net_pnl, sigma, CAST(trade_no AS BIGINT) AS i FROM t JOIN v ON t.symbol = v.symbol AND t.entry_ts = v.ts),
 z AS (SELECT symbol, CAST(-1 AS BIGINT) AS i, CAST(10000 AS DOUBLE) AS equity, CAST(10000 AS DOUBLE) AS peak, CAST(0 AS DOUBLE) AS dd, CAST(0 AS BIGINT) AS halted, CAST(NULL AS DOUBLE) AS size FROM g GROUP BY symbol
  UNION ALL SELECT symbol, i, e, greatest(peak, e), greatest(dd, greatest(peak, e) - e), halted + h, size FROM (SELECT g.symbol, g.i, z.peak, z.dd, z.halted, s.h, s.size, z.equity + s.size * g.net_pnl * 10 AS e FROM g JOIN z ON g.symbol = z.symbol AND g.i = z.i + 1,
   LATERAL (SELECT CASE WHEN z.equity <= 5000 THEN 1 ELSE 0 END AS h, CASE WHEN z.equity <= 5000 THEN 0.0 WHEN g.sigma > 0 AND z.equity > 0 THEN z.equity * 0.01 / (g.sigma * 10) ELSE 0.0 END AS size) s))"""


@area.add(f"{SIZED} SELECT symbol, round(max_by(equity, i), 4) AS final_equity, round(max_by(dd, i), 4) AS max_drawdown, max_by(halted, i) AS n_halted, round(min(size) FILTER (WHERE size > 0), 6) AS size_min, round(max(size) FILTER (WHERE size > 0), 6) AS size_max, round(avg(size) FILTER (WHERE size > 0), 6) AS size_mean FROM z GROUP BY symbol")
def equity_sizing(spark, sf_dir):
    """Compounded equity with positions sized by volatility."""
    sim = sizing.simulated(sized(spark, sf_dir), ("symbol",), contract=10.0)
    out = sim.select("symbol", r("final_equity", 4).alias("final_equity"), r("max_drawdown", 4).alias("max_drawdown"), "n_halted")
    return out.join(rounded(sizing.sizing_summary(sim, ("symbol",)).drop("n_halted")), "symbol")


FLAT = f"""{SIZED}, fs AS (SELECT symbol, 10000 * 0.01 / avg(sigma) FILTER (WHERE sigma > 0) / 10.0 AS size FROM g GROUP BY symbol),
 fe AS (SELECT g.symbol, i, net_pnl * size * 10.0 AS pnl, sum(net_pnl * size * 10.0) OVER (PARTITION BY g.symbol ORDER BY i) AS eq FROM g JOIN fs USING (symbol)), fk AS (SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY i) AS peak FROM fe)
 SELECT a.symbol, round(a.e, 4) AS dynamic_equity, round(a.d, 4) AS dynamic_drawdown, round(f.e, 4) AS flat_equity, round(f.d, 4) AS flat_drawdown
 FROM (SELECT symbol, max_by(equity, i) AS e, max_by(dd, i) AS d FROM z GROUP BY symbol) a JOIN (SELECT symbol, 10000 + sum(pnl) AS e, max(peak - eq) AS d FROM fk GROUP BY symbol) f USING (symbol)"""


@area.add(FLAT)
def flat_vs_dynamic(spark, sf_dir):
    """Sized by volatility against one size for all trades."""
    rows = sized(spark, sf_dir)
    dynamic = sizing.simulated(rows, ("symbol",), contract=10.0).select("symbol", F.col("final_equity").alias("dynamic_equity"), F.col("max_drawdown").alias("dynamic_drawdown"))
    size = rows.groupBy("symbol").agg((F.lit(sizing.CAPITAL * sizing.RISK) / F.avg(F.when(F.col("sigma") > 0, F.col("sigma"))) / 10.0).alias("size"))
    flat = rows.join(size, "symbol").withColumn("net_pnl", F.col("pnl") * F.col("size") * 10.0)
    flat = metrics.curves(flat, ("symbol",)).groupBy("symbol").agg((sizing.CAPITAL + F.sum("net_pnl")).alias("flat_equity"), F.max("drawdown").alias("flat_drawdown"))
    return rounded(dynamic.join(flat, "symbol"), digits=4)


QUERIES, ORACLES = area.queries, area.oracles
