"""Walk-forward runs, fixed splits and ablations, as plans over the operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import moments as mo
from ..operators import metrics, resample, strategies
from ..operators.ingest import split_60_20_20
from ..operators.kernels import Config
from ..operators.trades import trades
from ..sources.store import written
from . import folds

MIN_TRAIN, MIN_VALIDATION, TRIAL_TOP = 10, 15, 20


def totals(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, cfg_id, n, net of trade rows."""
    return rows.groupBy(*by, "cfg_id").agg(F.count("*").alias("n"), F.sum("net_pnl").alias("net"))


def best(scores: DataFrame, by: tuple[str, ...], least: int) -> DataFrame:
    """by, cfg_id, n, net of the highest net among those with enough trades; ties go to the first of the grid; none: no row."""
    w = Window.partitionBy(*by).orderBy(F.desc("net"), "cfg_id")
    return scores.where(F.col("n") >= least).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def best_or_busiest(scores: DataFrame, by: tuple[str, ...], least: int) -> DataFrame:
    """Like best(), but where none has enough trades the one with the most."""
    ok = F.col("n") >= least
    w = Window.partitionBy(*by).orderBy(F.desc(ok), F.desc(F.when(ok, F.col("net"))), F.desc("n"), "cfg_id")
    return scores.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def walk_forward(bars: DataFrame, model: str, grid: list[Config], train_days: int, test_days: int, cost: float, least: int = MIN_TRAIN, step_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The choice of each fold (symbol, fold, cfg_id, n, net) and the trades of the chosen configurations on the test spans.

    Every configuration runs cold on the train spans; only the chosen ones do
    on the test spans, each on the folds that chose it. Choice and trades are
    written tables, so that no reader runs the grid again.
    """
    by = ("symbol", "fold")
    cut = written(folds.fold_bars(bars, train_days, test_days, step_days), "folds")
    numbered = list(enumerate(grid))
    events = strategies.grid_events(cut.where("segment = 'train'"), model, numbered, by)
    choice = written(best(totals(trades(events, (*by, "cfg_id"), cost), by), by, least), "choice")
    tested = strategies.grid_events(cut.where("segment = 'test'").join(choice.select(*by), list(by), "left_semi"), model, numbered, by)
    tested = tested.join(choice.select(*by, "cfg_id"), [*by, "cfg_id"], "left_semi")
    return choice, written(trades(tested, (*by, "cfg_id"), cost), "test-trades")


def stitched(rows: DataFrame) -> DataFrame:
    """Test trades of all folds of a symbol as one list: trade_no runs over folds."""
    w = Window.partitionBy("symbol").orderBy("fold", "trade_no")
    return rows.withColumn("trade_no", (F.row_number().over(w) - 1).cast("long"))


def consistency(rows: DataFrame) -> DataFrame:
    """symbol, n_folds with a profit factor, share of them at 1 or above."""
    pf = rows.groupBy("symbol", "fold").agg(metrics.profit_factor(F.col("net_pnl")).alias("pf")).where("pf is not null")
    return pf.groupBy("symbol").agg(F.count("*").alias("n_folds"), F.avg((F.col("pf") >= 1.0).cast("double")).alias("consistency"))


def commonest(choice: DataFrame) -> DataFrame:
    """symbol, cfg_id chosen by the most folds; ties to the first of the grid."""
    n = choice.groupBy("symbol", "cfg_id").agg(F.count("*").alias("folds"))
    w = Window.partitionBy("symbol").orderBy(F.desc("folds"), "cfg_id")
    return n.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def fixed_walk_forward(bars: DataFrame, model: str, grid: list[Config], choice: DataFrame, train_days: int, test_days: int, cost: float) -> DataFrame:
    """Test trades of each symbol's one configuration (choice: symbol, cfg_id) over all folds, never chosen anew."""
    by = ("symbol", "fold")
    cut = folds.fold_bars(bars, train_days, test_days).where("segment = 'test'").join(choice.select("symbol"), "symbol", "left_semi")
    events = strategies.grid_events(cut, model, list(enumerate(grid)), by).join(choice.select("symbol", "cfg_id"), ["symbol", "cfg_id"], "left_semi")
    return trades(events, (*by, "cfg_id"), cost)


def random_entries(bars: DataFrame, rows: DataFrame, train_days: int, test_days: int, cost: float, runs: int = resample.SIMULATIONS) -> DataFrame:
    """The total of a walk's test trades against as many random entries in the same folds, summed by simulation."""
    w = Window.partitionBy("symbol", "fold").orderBy("ts")
    test = folds.fold_bars(bars, train_days, test_days).where("segment = 'test'").select("symbol", "fold", "close", (F.row_number().over(w) - 1).cast("long").alias("idx"))
    numbered = rows.withColumn("number", (F.row_number().over(Window.partitionBy("symbol").orderBy("fold", "trade_no")) - 1).cast("long"))
    return resample.monte_carlo(numbered, test, ("symbol",), runs, cost, ("fold",), "number")


def fixed_split(bars: DataFrame, model: str, grid: list[Config], cost: float, least: int = MIN_VALIDATION) -> DataFrame:
    """symbol, cfg_id, test metrics and deflated Sharpe ratio of the configuration chosen on the validation part.

    The grid runs once on both parts; the trial variance is that of the Sharpe
    ratios of the TRIAL_TOP best eligible configurations.
    """
    by = ("symbol", "part")
    parts = split_60_20_20(bars).where("part <> 'train'").drop("idx")
    rows = written(trades(strategies.grid_events(parts, model, list(enumerate(grid)), by), (*by, "cfg_id"), cost), "split-trades")
    validation, test = rows.where("part = 'validation'"), rows.where("part = 'test'")
    scores = totals(validation, ("symbol",))
    choice = best_or_busiest(scores, ("symbol",), least)
    w = Window.partitionBy("symbol").orderBy(F.desc("net"), "cfg_id")
    top = scores.where(F.col("n") >= least).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= TRIAL_TOP)
    sharpes = mo.moments(validation.join(top.select("symbol", "cfg_id"), ["symbol", "cfg_id"], "left_semi").withColumnRenamed("net_pnl", "ret"), ["symbol", "cfg_id"])
    spread = sharpes.groupBy("symbol").agg(F.coalesce(F.var_samp("sharpe"), F.lit(0.0)).alias("variance"))
    chosen = test.join(choice.select("symbol", "cfg_id"), ["symbol", "cfg_id"], "left_semi")
    judged = metrics.trade_metrics(chosen, ("symbol", "cfg_id")).join(mo.moments(chosen.withColumnRenamed("net_pnl", "ret"), ["symbol", "cfg_id"]).drop("n_trades"), ["symbol", "cfg_id"])
    judged = judged.join(spread, "symbol", "left").withColumn("variance", F.coalesce("variance", F.lit(0.0)))
    return mo.deflated(judged, F.lit(float(len(grid))), F.col("variance"))


def ablation(bars: DataFrame, model: str, plain: list[Config], hmm_bars: int, cost: float) -> DataFrame:
    """symbol, config (its place in plain), gated, n_trades, net, profit factor of each configuration with and without the regime gate."""
    grid = [(2 * i + on, replace(c, hmm_bars=hmm_bars if on else None)) for i, c in enumerate(plain) for on in (0, 1)]
    rows = trades(strategies.grid_events(bars, model, grid), ("symbol", "cfg_id"), cost)
    return rows.groupBy("symbol", F.shiftright("cfg_id", 1).alias("config"), (F.col("cfg_id") % 2 == 1).alias("gated")).agg(F.count("*").alias("n_trades"), F.sum("net_pnl").alias("net"), metrics.profit_factor(F.col("net_pnl")).alias("profit_factor"))


def correlation(validation: DataFrame, test: DataFrame, least: int) -> DataFrame:
    """symbol, n, spearman (ordinal ranks), pearson, slope, intercept of test on validation net over configurations with enough trades in both."""
    rows = validation.where(F.col("n") >= least).join(test.where(F.col("n") >= least).select("symbol", "cfg_id", F.col("net").alias("test_net")), ["symbol", "cfg_id"])
    rows = metrics.ordinal_ranks(rows, ("net", "test_net"), "cfg_id", ("symbol",))
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.corr("rank_net", "rank_test_net").alias("spearman"), F.corr("net", "test_net").alias("pearson"), F.regr_slope("test_net", "net").alias("slope"), F.regr_intercept("test_net", "net").alias("intercept"))
