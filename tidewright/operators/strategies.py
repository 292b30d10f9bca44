"""Strategies over series of bars, one configuration or a whole grid.

A series (symbol, or fold and segment of one) is an ordered recursion; its
state is carried over sorted batches. Configurations that share a calibration
window run together, so that bars are sent to Python once for each window, and
those that share a filter run it once; windows, series, folds and segments run
in parallel.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .carried import carried, numbers

INPUTS = ("open", "high", "low", "close", "volume")
BARS = ("ts", *INPUTS)
BANDS = {"trend": ("entry_high", "entry_low", "exit_high", "exit_low")}
MEAN_BANDS = ("mean_level", "sigma_stat", "upper_band", "lower_band")


def bands(model: str) -> tuple[str, ...]:
    return BANDS.get(model, MEAN_BANDS)


def banded(walk: kernels.Walk, batch: pa.RecordBatch, names: tuple[str, ...]) -> list[pa.Array]:
    """idx, close, bands and signal of a batch of bars."""
    first = walk.seen
    x = numbers(batch, INPUTS)
    found, [(at, events)] = walk.block(x)
    signal = np.full(batch.num_rows, None, object)
    signal[at] = events
    return [pa.array(np.arange(first, walk.seen)), pa.array(x["close"], from_pandas=True), *(pa.array(found[n], pa.float64(), from_pandas=True) for n in names), pa.array(signal, pa.string())]


def signals(bars: DataFrame, model: str, config: kernels.Config, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """by, ts, idx (from 0 in each series), close, the model's bands (null before warm-up) and signal, a row for each bar."""
    names = bands(model)
    kinds = {f.name: f.dataType.simpleString() for f in bars.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, "ts")) + ", idx long, close double, " + ", ".join(f"{n} double" for n in names) + ", signal string"

    def step(walk: kernels.Walk, b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in (*by, "ts")), *banded(walk, b, names)], names=[*by, "ts", "idx", "close", *names, "signal"])

    return carried(bars.select(*by, *BARS), by, "ts", lambda _: kernels.Walk(model, [config]), step, schema)


def grid_events(bars: DataFrame, model: str, grid: list[tuple[int, kernels.Config]], by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """by, cfg_id, ts, idx, close, signal: the rows of every configuration that have a signal."""
    groups: dict[int, list[tuple[int, kernels.Config]]] = defaultdict(list)
    for cfg_id, c in grid:
        groups[c.window if model != "trend" else c.entry_n].append((cfg_id, c))
    windows = F.array(*(F.lit(w) for w in groups)) if groups else F.array().cast("array<int>")
    kinds = {f.name: f.dataType.simpleString() for f in bars.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + f", cfg_id int, ts {kinds['ts']}, idx long, close double, signal string"

    def start(key: tuple) -> kernels.Walk:
        return kernels.Walk(model, [c for _, c in groups[key[-1]]])

    def step(walk: kernels.Walk, b: pa.RecordBatch) -> pa.RecordBatch:
        first, x = walk.seen, numbers(b, INPUTS)
        _, found = walk.block(x)
        at = np.array([i for places, _ in found for i in places], np.int64)
        ids = [cfg_id for (cfg_id, _), (places, _) in zip(groups[b.column("window")[0].as_py()], found, strict=True) for _ in places]
        rows = b.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*(rows.column(k) for k in by), pa.array(ids, pa.int32()), rows.column("ts"), pa.array(at + first), pa.array(x["close"][at], from_pandas=True), pa.array([n for _, names in found for n in names], pa.string())], names=[*by, "cfg_id", "ts", "idx", "close", "signal"])

    rows = bars.select(*by, *BARS, F.explode(windows).alias("window"))
    return carried(rows, (*by, "window"), "ts", start, step, schema)


def hmm_gate_matters(n_bars: int, config: kernels.Config) -> bool:
    """A series no longer than the regime calibration is never gated."""
    return bool(config.hmm_bars) and n_bars > config.hmm_bars
