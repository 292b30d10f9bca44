"""State carried from batch to batch: any cut of a series gives the same, and memory does not grow with it."""

import random
import resource

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidewright.functions import tables
from tidewright.operators import kernels, recursive, strategies
from tidewright.operators.carried import carried, numbers
from tidewright.operators.kernels import Config
from tidewright.sources import fixtures as fx


def bars(rng, n):
    x = np.zeros(n)
    for t in range(1, n):
        x[t] = 0.9 * x[t - 1] + rng.normal() * (6 if rng.random() < 0.03 else 1)
    close = 100 + x
    open_ = close + rng.normal(0, 0.5, n)
    return {"open": open_, "high": np.maximum(open_, close) + rng.random(n), "low": np.minimum(open_, close) - rng.random(n), "close": close, "volume": rng.integers(0, 50, n).astype(float)}


GRID = [
    Config(window=30, recalibrate=5, k=0.7, z_stop=2.5, half_lives=3.0, atr_stop=2.0, hmm_bars=60, spread=0.1),
    Config(window=30, recalibrate=5, k=1.2, side="long_only", adx_max=25, hurst_n=20, wick_min=0.1, volume_mult=0.8),
    Config(window=50, recalibrate=1, k=0.7, tau=9.0, trend=True, side="short_only", hmm_bars=60),
    Config(window=30, recalibrate=5, k=0.7, entry_n=20, exit_n=10, ema_n=30, atr_stop=1.0, garch=(0.5, 0.1, 0.85)),
]


@pytest.mark.parametrize("model", ["ou", "cir", "garch", "var", "jump", "trend"])
def test_any_cut_gives_the_same(model):
    rng, cuts = np.random.default_rng(3), random.Random(4)
    x = bars(rng, 420)
    x["close"][200] = np.nan
    grid = [c for c in GRID if c.garch] if model in ("garch", "var") else GRID
    want = [kernels.run(model, x, c)["signal"].tolist() for c in grid]
    assert model == "trend" or any(any(w) for w in want)
    for _ in range(3):
        walk, got, at = kernels.Walk(model, grid), [[] for _ in grid], 0
        while at < 420:
            n = cuts.choice((1, 2, 13, 64))
            part = {k: v[at : at + n] for k, v in x.items()}
            for own, (places, names) in zip(got, walk.block(part)[1], strict=True):
                rows = [None] * len(part["close"])
                for i, name in zip(places, names, strict=True):
                    rows[i] = name
                own += rows
            at += n
        assert got == want


def test_filters_are_shared():
    walk = kernels.Walk("ou", [Config(window=w, noise=n, k=k, tau=t) for w in (10, 20) for n in (1.0, 2.0) for k in (0.5, 1.0) for t in (None, 5.0)])
    walk.block(bars(np.random.default_rng(1), 100))
    assert len(walk.configs) == 16 and sum(kind is kernels.Series for kind, *_ in walk.parts) == 4


def test_signals_in_small_batches(spark):
    rows = fx.bars(spark, SF)
    config = Config(window=20, recalibrate=5, k=0.5, half_lives=2.0)
    want = sorted(map(str, strategies.signals(rows, "ou", config).collect()))
    smoothed = sorted(map(str, recursive.atr(rows).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert sorted(map(str, strategies.signals(rows, "ou", config).collect())) == want and len(want) == rows.count()
        assert sorted(map(str, recursive.atr(rows).collect())) == smoothed
        tables.register(spark)
        for model, table in (("ou", "run_ou"), ("trend", "run_trend")):
            config = Config(window=20, recalibrate=5, k=0.5) if model == "ou" else Config(entry_n=10, exit_n=5)
            text = '{"window": 20, "recalibrate": 5, "k": 0.5}' if model == "ou" else '{"entry_n": 10, "exit_n": 5}'
            got = spark.sql(f"SELECT * FROM {table}(TABLE(SELECT symbol, ts, open, high, low, close, volume FROM {{rows}}) PARTITION BY (symbol) ORDER BY (ts), {{text}})", rows=rows, text=text)
            assert sorted(map(str, got.collect())) == sorted(map(str, strategies.signals(rows, model, config).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_table_function_parameters():
    assert tables.config_of('{"hmm_block": [1, 2]}') == Config(hmm_block=(1, 2)) and tables.config_of(None) == Config()
    with pytest.raises(ValueError, match="nonsense"):
        tables.config_of('{"nonsense": 1}')


def test_one_long_series_in_bounded_memory(spark):
    """A million bars of one symbol: a worker grows by little more than a batch."""
    n = 1_000_000
    i = F.col("id")
    close = 1000 + F.sin(i / 7) + F.sin(i / 31)
    rows = spark.range(n).select(F.lit("a").alias("symbol"), F.timestamp_seconds(i * 60).cast("timestamp_ntz").alias("ts"), close.alias("open"), (close + 0.5).alias("high"), (close - 0.5).alias("low"), close.alias("close"), F.lit(1).cast("long").alias("volume"))

    def step(state, b):
        state.block(numbers(b, ("close",))["close"])
        return pa.RecordBatch.from_pydict({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024], "n": [b.num_rows]})

    got = carried(rows, ("symbol",), "ts", lambda _: kernels.Ewm(0.1), step, "mb double, n long").agg(F.min("mb"), F.max("mb"), F.sum("n"), F.count("*")).first()
    assert got[2] == n and got[3] >= 100 and got[1] < got[0] + 100
    assert recursive.ewm(rows, "close", "y", 0.1).agg(F.count("y")).first()[0] == n
