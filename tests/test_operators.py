import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from tidewright.functions import moments as mo
from tidewright.functions import normal
from tidewright.operators import ingest, kernels, metrics, sizing, strategies, trades
from tidewright.plans import grids
from tidewright.sources import schemas
from tidewright.streaming import bars as st


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("v")).first()["v"]


def test_normal(spark):
    for x, want in ((0.0, 0.5), (1.959963985, 0.975), (-1.959963985, 0.025)):
        assert abs(one(spark, normal.phi(F.col("x")), x=x) - want) < 1e-6
        assert abs(one(spark, normal.phi_inverse(F.col("p")), p=want) - x) < 1e-4


def test_trade_metrics_by_hand(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([4.0, -2.5, -0.5, 1.0, -3.0, 6.0])], "symbol string, trade_no long, net_pnl double")
    m = metrics.trade_metrics(rows, ("symbol",), curve=True).first()
    assert (m["n_trades"], m["win_rate"], m["max_drawdown"]) == (6, 0.5, 5.0) and math.isclose(m["profit_factor"], 11 / 6)
    assert math.isclose(m["expectancy"], 5 / 6) and m["equity_curve"] == [4.0, 1.5, 1.0, 2.0, -1.0, 5.0]


def test_single_loser_is_no_drawdown(spark):
    rows = spark.createDataFrame([("a", 0, -7.25)], "symbol string, trade_no long, net_pnl double")
    m = metrics.trade_metrics(rows, ("symbol",)).first()
    assert m["max_drawdown"] == 0 and m["profit_factor"] == 0


def test_deflated_sharpe(spark):
    rows = spark.createDataFrame([("a", 0.1 + math.sin(1.7 * i)) for i in range(180)], "symbol string, ret double")
    m = mo.moments(rows, ["symbol"])
    d = mo.deflated(m, F.lit(7.0), F.lit(0.003)).first()
    assert d["dsr"] <= d["psr_vs_zero"] and d["sr0"] > 0
    d = mo.deflated(m, F.lit(1.0), F.lit(0.003)).first()
    assert d["sr0"] == 0 and d["dsr"] == d["psr_vs_zero"]


def test_open_trade_is_dropped(spark):
    rows = spark.createDataFrame([("a", 0, 0, 1.0, "long")], "symbol string, ts long, idx long, close double, signal string")
    assert trades.trades(rows).count() == 0


def test_routing():
    assert schemas.database("EURUSD") == "raw_eurusd" and schemas.database() == "raw_gold" and schemas.database("VIX") == "raw_vix"
    assert schemas.timeframes("USDX") == ("h1",) and schemas.timeframes("XAUUSD") == ("m5", "m15", "h1")
    assert "data_source" not in schemas.bar_schema("XAGUSD").names and "data_source" in schemas.bar_schema("NDX100").names
    with pytest.raises(ValueError, match="database.*NZDCHF"):
        schemas.database("NZDCHF")


def test_offset(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 2, 29, 1, 30),)], "ts timestamp_ntz")
    assert ingest.corrected(rows, 7200).first()["ts"] == dt.datetime(2024, 2, 28, 23, 30)
    with pytest.raises(ValueError, match="not calibrated"):
        ingest.corrected(rows, None)
    assert ingest.corrected(rows.where("false"), None).count() == 0


@pytest.mark.parametrize(("n", "want"), [(95, 40), (17, 17)])
def test_paging(spark, n, want):
    start = dt.datetime(2025, 3, 1, 6, 30)
    rows = spark.createDataFrame([("a", start + dt.timedelta(minutes=i)) for i in range(n)], "symbol string, ts timestamp_ntz")
    got = [r["ts"] for r in ingest.increment(rows, F.lit(start).cast("timestamp_ntz"), 60, 40).collect()]
    assert got == [start + dt.timedelta(minutes=i) for i in range(want)]


def test_times():
    a, b = ingest.parsed_time("2023-11-05T18:45:00+05:30"), ingest.parsed_time("2023-11-05T21:15:00-03:00")
    assert b - a == dt.timedelta(hours=11)
    with pytest.raises(ValueError):
        ingest.parsed_time("2023-11-05T18:45:00")
    assert len(ingest.day_ranges(b, b + dt.timedelta(days=11), 5)) == 3


def test_grid_sizes():
    want = {"ou": 64, "ou_full": 192, "fixed": 192, "fixed_trend": 384, "cir": 108, "garch": 8, "var": 7, "jump": 48, "trend": 30, "long_only": 288}
    assert {n: len(grids.configs(n, 0.12)) for n in grids.SPECS} == want


@settings(max_examples=30, deadline=None)
@given(hs.lists(hs.one_of(hs.floats(-100, 100), hs.none()), min_size=1, max_size=40), hs.floats(0.05, 0.9))
def test_ewm_is_pandas(xs, alpha):
    x = pd.Series([np.nan if v is None else v for v in xs], dtype=float)
    assert np.allclose(kernels.ewm(x.to_numpy(), alpha, 3), x.ewm(alpha=alpha, adjust=False, min_periods=3).mean(), equal_nan=True)


def series(n=500, seed=0):
    rng = np.random.default_rng(seed)
    close = 1000 + np.cumsum(rng.normal(size=n)) * 0.4 + rng.normal(size=n) * 4
    return {"open": close - 0.5, "high": close + 1, "low": close - 1, "close": close, "volume": rng.integers(1, 50, n).astype(float)}


@pytest.mark.parametrize("model", ["ou", "cir", "jump", "garch", "var", "trend"])
def test_causal_and_alternating(model):
    c = kernels.Config(window=40, recalibrate=25, z_stop=3.0, half_lives=2.0, hmm_bars=100, entry_n=20, exit_n=10, atr_stop=2.0)
    x = series(300)
    whole, cut = kernels.run(model, x, c), kernels.run(model, {k: v[:200] for k, v in x.items()}, c)
    assert list(whole["signal"][:200]) == list(cut["signal"])
    events = [s for s in whole["signal"] if s]
    assert events and all((s in ("long", "short")) == (i % 2 == 0) for i, s in enumerate(events))


def test_garch_fit_is_no_worse_than_its_start():
    e = np.random.default_rng(1).normal(size=200)
    omega, alpha, beta = kernels.fit_garch(e)
    assert alpha + beta < 0.999 and kernels.garch_nll(e, omega, alpha, beta) <= kernels.garch_nll(e, 0.05 * e.var(), 0.10, 0.85)


@pytest.mark.parametrize("n", [30, 39, 59, 119])
def test_garch_fit_ends_where_no_small_step_helps(n):
    for seed in range(12):
        e = np.random.default_rng(seed).normal(size=n) * (1 + seed % 3 * (np.arange(n) > n // 2))
        omega, alpha, beta = kernels.fit_garch(e)
        near = [(omega * a, max(alpha + b, 0), max(beta + c, 0)) for a in (0.98, 1, 1.02) for b in (-0.01, 0, 0.01) for c in (-0.01, 0, 0.01)]
        assert kernels.garch_nll(e, omega, alpha, beta) <= min(kernels.garch_nll(e, *p) for p in near) + 1e-4


def test_garch_fit_of_odd_residuals():
    assert kernels.fit_garch(np.arange(29.0))[1:] == (0.0, 0.0)
    for e in (np.zeros(40), np.full(40, 3.0), np.r_[np.zeros(39), 1.0], np.arange(40.0) * 1e140, np.arange(40.0) * 1e-9):
        omega, alpha, beta = kernels.fit_garch(e)
        assert omega > 0 and alpha >= 0 and beta >= 0 and alpha + beta < 0.999
    with np.errstate(all="ignore"):
        assert kernels.fit_garch(np.arange(40.0) * 1e160)[1:] == (0.0, 0.0)


def test_regimes_split_a_calm_and_a_wild_series():
    v = np.concatenate([np.full(100, 0.01), np.full(100, 0.05)]) * (1 + 0.1 * np.random.default_rng(0).random(200))
    hmm = kernels.Regimes.calibrated(v)
    assert hmm.step(0.01) == 0 and [hmm.step(0.055) for _ in range(5)][-1] == 2


def test_sizing_halts(spark):
    rows = spark.createDataFrame([("a", 0, -60.0, 1.0), ("a", 1, 10.0, 1.0), ("a", 2, 10.0, None)], "symbol string, trade_no long, pnl double, sigma double")
    s = sizing.simulated(rows, ("symbol",), contract=1.0).first()
    assert s["n_halted"] == 2 and s["sizes"] == [100.0, 0.0, 0.0] and s["final_equity"] == 4000.0


def test_histogram_closes_its_last_bin(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(21)], "x double")
    got = {r["bin"]: r["n"] for r in metrics.histogram(rows, "x").collect()}
    assert got[19] == 2 and sum(got.values()) == 21


def test_stream_equals_batch(spark):
    from conftest import SF

    from tidewright import queries as library
    from tidewright.operators import recursive as rec
    from tidewright.sources import fixtures as fx

    batch = rec.mean_filter(fx.bars(spark, SF), "ou", window=40, recalibrate=5).where("x is not null")
    want = {(r["symbol"], r["ts"]): round(r["x"], 4) for r in batch.collect()}
    got = {(r["symbol"], r["ts"]): r["x"] for r in library.QUERIES["stream_filter"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in want)


def test_retries():
    waits, calls = [], []

    def start():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")
        return "up"

    assert st.with_retries(start, sleep=waits.append) == "up" and waits == [2.0, 4.0]


def test_gate_needs_more_bars_than_it_calibrates():
    c = kernels.Config(hmm_bars=100)
    assert not strategies.hmm_gate_matters(100, c) and strategies.hmm_gate_matters(101, c)
