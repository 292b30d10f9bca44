"""Walk-forward and split plans against plain loops over the same bars."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from conftest import SF

from tidewright.operators import kernels
from tidewright.plans import experiments as ex
from tidewright.queries import experiments as q
from tidewright.sources import fixtures as fx


def trips(bars, model, c):
    """Net results of one cold run, in order."""
    x, out, entry = {k: bars[k].to_numpy(float) for k in ("open", "high", "low", "close", "volume")}, [], None
    for i, s in enumerate(kernels.run(model, x, c)["signal"]):
        if s in ("long", "short"):
            entry = x["close"][i], 1 if s == "long" else -1
        elif s is not None:
            out.append((x["close"][i] - entry[0]) * entry[1] - fx.COST)
            entry = None
    return out


def folds_of(bars, train, test):
    day, k = pd.Timedelta(days=1), 0
    start, last = bars["ts"].min(), bars["ts"].max()
    while (at := start + k * test * day) + (train + test) * day <= last:
        middle, end = at + train * day, at + (train + test) * day
        yield k, bars[(bars["ts"] >= at) & (bars["ts"] < middle)], bars[(bars["ts"] >= middle) & (bars["ts"] < end)]
        k += 1


def parts_of(bars):
    """(validation, test) of each symbol."""
    for symbol, own in bars.groupby("symbol"):
        own, n = own.sort_values("ts"), len(own)
        yield symbol, own[int(n * 0.6) : int(n * 0.8)], own[int(n * 0.8) :]


def close_to(got, want):
    return len(got) == len(want) and np.allclose(got, want, atol=1e-6)


@pytest.mark.parametrize(("model", "changes"), [("ou", {}), ("cir", {}), ("jump", {"jump_z": (3.5,)})])
def test_walk_forward(spark, model, changes):
    daily, grid = fx.daily(spark, SF), q.small(model, **changes)
    choice, rows = ex.walk_forward(daily, model, grid, q.LONG_TRAIN, q.LONG_TEST, fx.COST, q.LEAST)
    chosen = {r["fold"]: (r["cfg_id"], r["n"], r["net"]) for r in choice.collect()}
    tested = rows.orderBy("fold", "trade_no").toPandas()
    bars, all_net, n_chosen = daily.toPandas().sort_values("ts"), [], 0
    bars["ts"] = pd.to_datetime(bars["ts"])
    for fold, train, test in folds_of(bars, q.LONG_TRAIN, q.LONG_TEST):
        runs = [trips(train, model, c) for c in grid]
        able = [i for i, x in enumerate(runs) if len(x) >= q.LEAST]
        if not able:
            assert fold not in chosen
            continue
        best = max(able, key=lambda i: (round(sum(runs[i]), 9), -i))
        assert chosen[fold][:2] == (best, len(runs[best])) and abs(chosen[fold][2] - sum(runs[best])) < 1e-6
        want = trips(test, model, grid[best])
        assert close_to(tested[tested["fold"] == fold]["net_pnl"], want)
        n_chosen, all_net = n_chosen + 1, all_net + want
    assert n_chosen == len(chosen) > 0
    judged = ex.stitched(rows)
    assert close_to([r["net_pnl"] for r in judged.orderBy("trade_no").collect()], all_net)
    factors = [sum(v for v in x if v > 0) / -sum(v for v in x if v <= 0) if any(v <= 0 for v in x) else np.inf for _, x in tested.groupby("fold")["net_pnl"]]
    got = ex.consistency(rows).first()
    assert (got is None and not factors) or (got["n_folds"], got["consistency"]) == (len(factors), pytest.approx(np.mean([f >= 1 for f in factors])))


def test_fixed_split(spark):
    hourly, grid, want = fx.bars(spark, SF), q.small(), {}
    for symbol, validation, test in parts_of(hourly.toPandas()):
        runs = [trips(validation, "ou", c) for c in grid]
        able = [i for i, x in enumerate(runs) if len(x) >= ex.MIN_VALIDATION]
        if able:
            best = max(able, key=lambda i: (round(sum(runs[i]), 9), -i))
        elif any(runs):
            best = max(range(len(grid)), key=lambda i: (len(runs[i]), -i))
        else:
            continue
        if net := trips(test, "ou", grid[best]):
            want[symbol] = best, len(net), np.mean(net), np.mean([v > 0 for v in net])
    got = {r["symbol"]: r for r in ex.fixed_split(hourly, "ou", grid, fx.COST).collect()}
    assert got.keys() == want.keys() and want
    for symbol, (best, n, mean, won) in want.items():
        r = got[symbol]
        assert (r["cfg_id"], r["n_trades"]) == (best, n) and close_to([r["expectancy"], r["win_rate"]], [mean, won])


def test_validation_ranks_test(spark):
    grid, want = q.small(), {}
    for symbol, validation, test in parts_of(fx.bars(spark, SF).toPandas()):
        pairs = [(sum(a), sum(b)) for a, b in ((trips(validation, "ou", c), trips(test, "ou", c)) for c in grid) if len(a) >= q.LEAST and len(b) >= q.LEAST]
        if pairs:
            want[symbol] = np.array(pairs)
    got = {r["symbol"]: r for r in q.QUERIES["val_test_corr"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for symbol, x in want.items():
        assert got[symbol]["n"] == len(x)
        if len(x) > 2 and np.ptp(x[:, 0]) > 1e-9 and np.ptp(x[:, 1]) > 1e-9:
            assert abs(got[symbol]["pearson"] - np.corrcoef(x.T)[0, 1]) < 1e-3
            assert abs(got[symbol]["slope"] - np.polyfit(x[:, 0], x[:, 1], 1)[0]) < 1e-3


def test_ablation(spark):
    want = {}
    for symbol, _, test in parts_of(fx.bars(spark, SF).toPandas()):
        for i, c in enumerate(q.ablation_grid()):
            for gated in (False, True):
                if net := trips(test, "ou", replace(c, hmm_bars=q.ABLATION_HMM if gated else None)):
                    want[symbol, i, gated] = len(net), sum(net)
    got = {(r["symbol"], r["config"], r["gated"]): (r["n_trades"], r["net"]) for r in q.QUERIES["hmm_ablation"](spark, SF).collect()}
    assert got.keys() == want.keys() and want
    for key, (n, net) in want.items():
        assert got[key][0] == n and abs(got[key][1] - net) < 1e-5


def test_walk_forward_with_fitted_variances(spark, monkeypatch):
    known, fit = {}, kernels.fit_garch

    def once(e):  # configurations of a window have the same residuals
        key = e.tobytes()
        if key not in known:
            known[key] = fit(e)
        return known[key]

    monkeypatch.setattr(kernels, "fit_garch", once)
    test_walk_forward(spark, "garch", q.GARCH)


def test_wfo_garch_fits_in_every_configuration(spark, monkeypatch):
    grids, fits, fit = [], [], kernels.fit_garch

    def taken(bars, model, grid, *_):
        grids.append((bars.toPandas().sort_values("ts"), grid))
        raise StopIteration

    def counted(e):
        fits.append((len(e), *fit(e)))
        return fits[-1][1:]

    monkeypatch.setattr(ex, "walk_forward", taken)
    with pytest.raises(StopIteration):
        q.QUERIES["wfo_garch"](spark, SF)
    monkeypatch.setattr(kernels, "fit_garch", counted)
    ((bars, grid),) = grids
    assert len({c.window for c in grid}) > 1 and len({c.k for c in grid}) > 1
    for c in grid:
        fits.clear()
        trips(bars[:300], "garch", c)
        assert fits and all(n >= 30 for n, *_ in fits) and any(alpha + beta > 0 for _, _, alpha, beta in fits)
