"""Streams whose state is typed: the batch's events, whatever the batches and restarts."""

import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_carried import GRID, bars

from tidewright.operators import kernels, strategies
from tidewright.sources import fixtures as fx
from tidewright.streaming import stateful


@pytest.mark.parametrize("model", ["ou", "cir", "garch", "var", "jump", "trend"])
def test_saved_and_restored_between_blocks(model):
    rng, cuts = np.random.default_rng(6), random.Random(7)
    for c in (c for c in GRID if c.garch or model not in ("garch", "var")):
        x, got, at, state = bars(rng, 250), [], 0, ({}, {})
        while at < 250:
            n = cuts.choice((1, 2, 13, 64))
            walk = kernels.Walk(model, [c])
            walk.block({k: np.zeros(0) for k in x})
            walk = stateful.restored(walk, *state)
            part = {k: v[at : at + n] for k, v in x.items()}
            _, [(places, names)] = walk.block(part)
            rows = [None] * len(part["close"])
            for i, name in zip(places, names, strict=True):
                rows[i] = name
            got, at, state = got + rows, at + n, stateful.saved(walk)
            assert all(isinstance(v, float) for v in state[0].values())
        assert got == kernels.run(model, x, c)["signal"].tolist()


def test_restart_in_the_middle(spark, tmp_path):
    rows = fx.bars(spark, SF).where("symbol in ('click', 'view')")
    config = kernels.Config(window=20, recalibrate=5, k=0.5, half_lives=2.0, atr_stop=3.0)
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    cuts = [F.lit(x).cast("timestamp_ntz") for x in ("2024-01-01", "2024-01-09", "2024-01-17", "2025-01-01")]

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
        events = stateful.online_signals(stream, "ou", config)
        events.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        # Each part once more than new: what was seen is left out.
        rows.where((F.col("ts") >= a - F.expr("INTERVAL 3 HOURS")) & (F.col("ts") < b)).coalesce(1).write.mode("append").parquet(src)
        run()
    got = spark.read.parquet(out)
    want = strategies.signals(rows, "ou", config).where("signal is not null").select("symbol", "ts", "idx", "close", "signal")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 3
