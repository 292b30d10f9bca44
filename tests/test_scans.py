"""Smoothing by blocks of time against the row-by-row fold."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import kernels, scans


@pytest.fixture(scope="module")
def series(spark):
    rng, rows = np.random.default_rng(9), []
    for symbol, n, gap in (("a", 1500, 0.0), ("b", 700, 0.4), ("c", 1, 0.0), ("d", 30, 0.0)):
        t, x = dt.datetime(2024, 1, 1), 100.0
        for _ in range(n):
            x += rng.normal()
            rows.append((symbol, t, x - 0.2, x + rng.random(), x - rng.random(), x, int(rng.integers(0, 9))))
            t += dt.timedelta(hours=1 + (int(rng.integers(1, 900)) if rng.random() < gap / 10 else 0))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long").persist()


def by_rows(series, fold):
    return {s: fold({c: own[c].to_numpy(float) for c in ("high", "low", "close")}) for s, own in series.toPandas().sort_values("ts").groupby("symbol")}


@pytest.mark.parametrize("name,fold,scan", [
    ("y", lambda x: kernels.ewm(x["close"], 0.3, 5), lambda d: scans.ewm(d, {"close": "y"}, 0.3, 3600, 5)),
    ("atr", lambda x: kernels.Atr(14).block(x), lambda d: scans.atr(d, 3600)),
    ("adx", lambda x: kernels.Adx(14).block(x), lambda d: scans.adx(d, 3600)),
])
def test_equals_the_fold(series, name, fold, scan):
    got = scan(series).toPandas().sort_values("ts")
    for symbol, want in by_rows(series, fold).items():
        own = got[got["symbol"] == symbol][name].to_numpy(float)
        own = np.concatenate((np.full(len(want) - len(own), np.nan), own))
        assert np.allclose(own, want, rtol=1e-9, equal_nan=True), symbol
    assert scan(series.limit(0)).count() == 0


def test_blocks_are_the_largest_groups(series):
    """Windows over rows are parted by block; those over a whole series see a row for each block."""
    plan = scans.atr(series, 3600)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan
    sizes = scans.blocked(series, 3600).groupBy("symbol", "__block").count().agg(F.max("count")).first()[0]
    assert sizes <= scans.BLOCK_ROWS


def test_fast_decay_is_refused(series):
    with pytest.raises(ValueError):
        scans.ewm(series, {"close": "y"}, 0.99, 3600)
