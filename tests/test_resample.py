"""Draws are as random as draws must be, and the same in Spark and SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import resample


def draws(spark, runs, n, salt=resample.PICK):
    rows = spark.range(runs).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("b", "i", resample.draw(F.col("b"), F.col("i"), salt).alias("x"))
    return rows.orderBy("b", "i").toPandas()["x"].to_numpy().reshape(runs, n)


def test_same_in_sql(spark, duck):
    want = duck.sql(f"select {resample.draw_sql('b', 'i', 2)} as x from range(40) r(b), range(50) s(i) order by b, i").fetchall()
    assert draws(spark, 40, 50, 2).ravel().tolist() == [x for (x,) in want]
    assert draws(spark, 3, 4)[2, 3] == resample.mixed(resample.mixed(2 ^ resample.key(0)) ^ 3)


@pytest.mark.parametrize("n", [15, 64, 100, 128, 300])
def test_spread_of_resampled_means(spark, n):
    values = np.random.default_rng(n).normal(0.1, 1, n)
    picks = draws(spark, resample.BOOTSTRAP_RUNS, n) % n
    means = values[picks].mean(1)
    assert abs(means.std() / (values.std() / np.sqrt(n)) - 1) < 0.05
    # Each run leaves out about a part of 1/e, as draws with replacement do.
    missed = 1 - np.mean([len(set(p)) for p in picks[:500].tolist()]) / n
    assert abs(missed - (1 - 1 / n) ** n) < 0.02
    counts = np.bincount(picks.ravel(), minlength=n)
    assert ((counts - counts.mean()) ** 2 / counts.mean()).sum() < n + 6 * np.sqrt(2 * n)


def test_salts_runs_and_counters_are_independent(spark):
    a, b = draws(spark, 400, 100, resample.ENTRY), draws(spark, 400, 100, resample.WAY)
    halves = lambda x, y: np.histogram2d(x.ravel() >> 30, y.ravel() >> 30, bins=4)[0]
    for x, y in ((a, b), (a[:, :-1], a[:, 1:]), (a[:-1], a[1:]), (a, b[::-1])):
        table = halves(x, y)
        assert ((table - table.mean()) ** 2 / table.mean()).sum() < 15 + 6 * np.sqrt(30)
    # Avalanche: one bit of a counter turns about half of the bits drawn.
    flips = np.zeros((32, 32))
    rng = np.random.default_rng(0)
    for x in rng.integers(0, 1 << 32, 500).tolist():
        for k in range(32):
            d = resample.mixed(x) ^ resample.mixed(x ^ 1 << k)
            flips[k] += [d >> j & 1 for j in range(32)]
    assert 0.35 < flips.min() / 500 and flips.max() / 500 < 0.65


def test_bootstrap_and_simulations_by_hand(spark):
    rng = np.random.default_rng(5)
    net, spans, closes = rng.normal(0, 1, 6), [1, 3, 2, 50, 1, 2], {0: rng.normal(100, 2, 12), 1: rng.normal(50, 1, 9), 2: [1.0, 2.0]}
    fold = [0, 0, 0, 0, 1, 2]
    rows = [("a", f, i - fold.index(f), i, 0, spans[i], float(net[i])) for i, f in enumerate(fold)]
    trades = spark.createDataFrame(rows, "symbol string, fold int, trade_no long, number long, entry_idx long, exit_idx long, net_pnl double")
    bars = spark.createDataFrame([("a", f, i, float(x)) for f, c in closes.items() for i, x in enumerate(c)], "symbol string, fold int, idx long, close double")
    draw = lambda b, i, salt: resample.mixed(resample.mixed(b ^ resample.key(salt)) ^ i)
    totals = []
    for b in range(200):
        total = 0.0
        for i, f in enumerate(fold):
            if len(closes[f]) < 3:
                continue
            own = [spans[k] for k in range(6) if fold[k] == f]
            span = min(max(own[draw(b, i, 0) % len(own)], 1), len(closes[f]) - 1)
            at = draw(b, i, 1) % (len(closes[f]) - span)
            total += (1 if draw(b, i, 2) >= 1 << 31 else -1) * (closes[f][at + span] - closes[f][at]) - 0.1
        totals.append(total)
    got = resample.monte_carlo(trades, bars, ("symbol",), 200, 0.1, ("fold",), "number").first()
    assert abs(got["sim_mean"] - np.mean(totals)) < 1e-9 and abs(got["sim_std"] - np.std(totals)) < 1e-9 and abs(got["real"] - net.sum()) < 1e-9
    assert abs(got["percentile"] - np.mean(np.array(totals) < net.sum())) < 1e-9 and abs(got["sim_p05"] - np.percentile(totals, 5)) < 1e-9
    got = resample.bootstrap(trades.select("symbol", F.col("number").alias("trade_no"), "net_pnl"), ("symbol",), 300).first()
    means = [np.mean([net[draw(b, i, 0) % 6] for i in range(6)]) for b in range(300)]
    assert np.allclose([got["lower"], got["upper"], got["p_positive"]], [np.percentile(means, 2.5), np.percentile(means, 97.5), np.mean(np.array(means) > 0)])
