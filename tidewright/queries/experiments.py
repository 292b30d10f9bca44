"""Grids, folds and walk-forward runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, metrics, resample, strategies
from ..operators.kernels import Config
from ..operators.trades import trades
from ..plans import experiments as ex
from ..plans import folds, grids
from ..sources import fixtures as fx
from .common import Area, r, rounded

area = Area()
#: The fixtures' walks revert within tens of bars: shorter windows and narrower bands than the production grids.
SMALL = {"window": (10, 20), "k": (0.5, 1.0), "noise": ((1.0, 1.0), (2.0, 0.5)), "share": (None,)}
TRAIN, TEST, LEAST = 90, 30, 2
#: A clustered variance is fitted to 30 residuals or more, so no window of SMALL will do; time-outs as in production.
GARCH = {"window": (40, 60), "share": (1.0, None)}
#: Window, k and noise of the ablation, at the fixtures' scale.
ABLATION = ((20, 0.5, 1.0), (10, 0.5, 0.5), (10, 1.0, 1.0), (20, 1.0, 1.0), (15, 0.5, 1.0), (15, 0.5, 0.5))
ABLATION_HMM = 60
#: Walks run cold on each test span, which must be longer than a calibration window.
LONG_TRAIN, LONG_TEST = 360, 120


def ablation_grid() -> list[Config]:
    return [Config(window=w, recalibrate=5, k=k, z_stop=k + 1, q=1.0, noise=noise, tau=float(w), half_lives=2.0, spread=fx.COST) for w, k, noise in ABLATION]


def small(model: str = "ou", **changes) -> list[Config]:
    return grids.configs(model, fx.COST, None, **(SMALL | changes))


def _grid(name: str) -> None:
    spec = grids.SPECS[name]
    dims = {k: v for k, v in spec.items() if k in ("window", "k", "share", "trend", "entry_pct", "stop_pct", "jump_z", "ema_n", "atr_stop")}
    froms = [f'(SELECT CAST(unnest([{", ".join("NULL" if x is None else str(x).lower() for x in v)}]) AS {"BOOLEAN" if k == "trend" else "DOUBLE"}) AS "{k}")' for k, v in dims.items()]
    if "noise" in spec:
        froms.append(f"(VALUES {', '.join(map(str, spec['noise']))}) n(q, noise)")
    if "channel" in spec:
        froms.append(f"(VALUES {', '.join(map(str, spec['channel']))}) c(entry_n, exit_n)")
    where = " WHERE stop_pct > entry_pct" if name == "var" else ""
    tau = '"window" * share' if "share" in spec else "NULL"
    sql = f"SELECT count(*) AS n, count(DISTINCT cfg) AS n_distinct, round(sum(coalesce(tau, 0)), 6) AS tau_sum, round(sum(w), 6) AS window_sum FROM (SELECT row_number() OVER () AS cfg, CAST({tau} AS DOUBLE) AS tau, CAST({'"window"' if "window" in spec else 60} AS DOUBLE) AS w FROM {', '.join(froms)}{where})"

    def query(spark, sf_dir):
        rows = grids.frame(spark, name, fx.COST)
        return rows.agg(F.count("*").alias("n"), F.countDistinct("cfg_id").alias("n_distinct"), r(F.sum(F.coalesce("tau", F.lit(0.0)))).alias("tau_sum"), r(F.sum("window")).alias("window_sum"))

    query.__name__, query.__doc__ = f"grid_{name}", f"The {name} grid's size and sums."
    area.add(sql)(query)


for _name in ("ou", "ou_full", "fixed", "fixed_trend", "cir", "garch", "var", "jump", "trend", "long_only"):
    _grid(_name)

FOLDS = f"""{fx.with_('daily')}, e AS (SELECT symbol, min(ts) AS start, max(ts) AS last FROM daily GROUP BY symbol), f AS (SELECT symbol, CAST(k AS INTEGER) AS fold, start + to_days(CAST(k * {TEST} AS INTEGER)) AS train_start FROM e, range(1000) r(k) WHERE start + to_days(CAST(k * {TEST} + {TRAIN + TEST} AS INTEGER)) <= last)"""


@area.add(f"{FOLDS} SELECT symbol, fold, train_start, train_start + INTERVAL {TRAIN} DAY AS train_end, train_start + INTERVAL {TRAIN + TEST} DAY AS test_end FROM f")
def make_folds(spark, sf_dir):
    """Folds of ninety days and thirty."""
    return folds.make_folds(fx.daily(spark, sf_dir), TRAIN, TEST)


@area.add(f"{FOLDS} SELECT f.fold, CASE WHEN d.ts < train_start + INTERVAL {TRAIN} DAY THEN 'train' ELSE 'test' END AS segment, count(*) AS n, round(sum(close), 7) AS closes FROM f JOIN daily d ON d.ts >= train_start AND d.ts < train_start + INTERVAL {TRAIN + TEST} DAY GROUP BY 1, 2")
def fold_bars(spark, sf_dir):
    """Bars of each fold and segment."""
    return rounded(folds.fold_bars(fx.daily(spark, sf_dir), TRAIN, TEST).groupBy("fold", "segment").agg(F.count("*").alias("n"), F.sum("close").alias("closes")), digits=7)


@area.add()
def wfo_select(spark, sf_dir):
    """The configuration each fold chooses on its train span."""
    choice, _ = ex.walk_forward(fx.daily(spark, sf_dir), "ou", small(), LONG_TRAIN, LONG_TEST, fx.COST, LEAST)
    return rounded(choice)


def _walk(name: str, model: str, doc: str, grid: list[Config], train: int = LONG_TRAIN, test: int = LONG_TEST) -> None:
    def query(spark, sf_dir):
        _, rows = ex.walk_forward(fx.daily(spark, sf_dir), model, grid, train, test, fx.COST, LEAST)
        rows = ex.stitched(rows)
        return rounded(metrics.trade_metrics(rows, ("symbol",)).join(ex.consistency(rows), "symbol"))

    query.__name__, query.__doc__ = name, doc
    area.add()(query)


_walk("wfo_ou", "ou", "Walk-forward of the constant-variance model.", small())
_walk("wfo_cir", "cir", "Walk-forward of the level-dependent model.", small("cir"))
_walk("wfo_jump", "jump", "Walk-forward of the jump model.", small("jump", jump_z=(3.5,)))
_walk("wfo_garch", "garch", "Walk-forward of the clustered-variance model.", small("garch", **GARCH))
_walk("wfo_var", "var", "Walk-forward of the clustered-variance model with percentile bands.", small("var", window=(60,), entry_pct=(80.0, 90.0), stop_pct=(99.0, 99.5)))
_walk("wfo_trend", "trend", "Walk-forward of the channel breakout.", grids.configs("trend", None, channel=((10, 5), (20, 10)), ema_n=(None,)))
#: The grids of production, on spans that hold their longest windows. The regime gate needs more bars than a span has.
for _name in ("ou", "cir", "jump", "garch", "var", "trend"):
    _walk(f"wfo_{_name}_grid", _name, f"Walk-forward of the whole {_name} grid.", grids.configs(_name, fx.COST), 720, 240)


@area.add()
def wfo_significance(spark, sf_dir):
    """Bootstrap interval of the stitched test trades."""
    _, rows = ex.walk_forward(fx.daily(spark, sf_dir), "ou", small(), LONG_TRAIN, LONG_TEST, fx.COST, LEAST)
    return rounded(resample.bootstrap(ex.stitched(rows).select("symbol", "trade_no", "net_pnl"), ("symbol",), resample.BOOTSTRAP_RUNS))


@area.add()
def wfo_monte_carlo(spark, sf_dir):
    """The stitched test trades against random entries in the same folds, summed by simulation."""
    bars = fx.daily(spark, sf_dir)
    _, rows = ex.walk_forward(bars, "ou", small(), LONG_TRAIN, LONG_TEST, fx.COST, LEAST)
    return rounded(ex.random_entries(bars, rows, LONG_TRAIN, LONG_TEST, fx.COST), "percentile", digits=5)


@area.add()
def fixed_config_wf(spark, sf_dir):
    """Each symbol's commonest choice over all folds, never chosen anew."""
    bars, grid = fx.daily(spark, sf_dir), small()
    choice, _ = ex.walk_forward(bars, "ou", grid, LONG_TRAIN, LONG_TEST, fx.COST, LEAST)
    rows = ex.stitched(ex.fixed_walk_forward(bars, "ou", grid, ex.commonest(choice), LONG_TRAIN, LONG_TEST, fx.COST))
    return rounded(metrics.trade_metrics(rows, ("symbol",)))


@area.add()
def wfo_window_sensitivity(spark, sf_dir):
    """Shorter spans of the same proportion."""
    _, rows = ex.walk_forward(fx.daily(spark, sf_dir), "ou", small(), 240, 80, fx.COST, LEAST)
    return rounded(metrics.trade_metrics(ex.stitched(rows), ("symbol",)))


@area.add()
def eval_fixed_split(spark, sf_dir):
    """Chosen on validation, judged once on test, with a deflated Sharpe ratio."""
    return rounded(ex.fixed_split(fx.bars(spark, sf_dir), "ou", small(), fx.COST))


@area.add()
def eval_long_only(spark, sf_dir):
    """The same, longs alone, with and without a drifting mean."""
    return rounded(ex.fixed_split(fx.bars(spark, sf_dir), "ou", small(trend=(False, True), side=("long_only",)), fx.COST))


@area.add()
def hmm_ablation(spark, sf_dir):
    """Six configurations with and without the regime gate, on the test part."""
    test = ingest.split_60_20_20(fx.bars(spark, sf_dir)).where("part = 'test'").drop("idx", "part")
    return rounded(ex.ablation(test, "ou", ablation_grid(), ABLATION_HMM, fx.COST))


@area.add()
def val_test_corr(spark, sf_dir):
    """How validation results rank test results."""
    by = ("symbol", "part")
    parts = ingest.split_60_20_20(fx.bars(spark, sf_dir)).where("part <> 'train'").drop("idx")
    rows = ex.totals(trades(strategies.grid_events(parts, "ou", list(enumerate(small())), by), (*by, "cfg_id"), fx.COST), by)
    return rounded(ex.correlation(rows.where("part = 'validation'").drop("part"), rows.where("part = 'test'").drop("part"), LEAST), digits=4)


QUERIES, ORACLES = area.queries, area.oracles
