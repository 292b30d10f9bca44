"""Ordered recursions over a series: smoothing, mean filters, regimes.

A recursion carries state from bar to bar, which no window frame expresses; it
is folded over sorted batches (`carried`). For one long series see `scans`,
which composes blocks of it instead.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels
from .carried import carried, numbers


def folded(rows: DataFrame, by: tuple[str, ...], inputs: tuple[str, ...], start: Callable[[], Any], block: Callable[[Any, dict[str, np.ndarray]], dict[str, np.ndarray]], add: tuple[str, ...]) -> DataFrame:
    """rows with the columns `add` that block(state, inputs) makes of each batch of a series."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{c} double" for c in add])

    def step(state: Any, b: pa.RecordBatch) -> pa.RecordBatch:
        out = block(state, numbers(b, inputs))
        return pa.RecordBatch.from_arrays([*b.columns, *(pa.array(out[c], pa.float64(), from_pandas=True) for c in add)], names=[*b.schema.names, *add])

    return carried(rows, by, "ts", lambda _: start(), step, schema)


def ewm(rows: DataFrame, column: str, out: str, alpha: float, warmup: int = 0, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Exponential smoothing from the first value on; null before `warmup` values."""
    return folded(rows, by, (column,), lambda: kernels.Ewm(alpha, warmup), lambda s, x: {out: s.block(x[column])}, (out,))


def atr(rows: DataFrame, n: int = 14, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return folded(rows, by, ("high", "low", "close"), lambda: kernels.Atr(n), lambda s, x: {"atr": s.block(x)}, ("atr",))


def adx(rows: DataFrame, n: int = 14, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return folded(rows, by, ("high", "low", "close"), lambda: kernels.Adx(n), lambda s, x: {"adx": s.block(x)}, ("adx",))


def mean_filter(rows: DataFrame, model: str, by: tuple[str, ...] = ("symbol",), **params) -> DataFrame:
    """rows with x (filtered mean) and sigma_stat of a model: ou, cir, garch or jump."""
    config = kernels.Config(**params)
    return folded(rows, by, ("close",), lambda: kernels.Series(model, config), lambda s, x: s.block(x["close"]), ("x", "sigma_stat"))


def regimes(rows: DataFrame, column: str, calibration: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """rows with the state (0 to 2) of a three-state volatility model, from the calibration rows on."""
    return folded(rows, by, (column,), lambda: kernels.Regime(calibration), lambda s, x: {"state": s.block(x[column])}, ("state",))
