"""Filters and strategies over streams of bars, their state typed and readable.

What a series carries (`kernels`) is kept as numbers and arrays by name in map
states, and its place as a value state; so state can be read with Spark's
state reader, and survives a change of code that keeps the names. Bars of a
series must come in order of time from batch to batch; within a batch they are
sorted, and those not after the last one seen are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import kernels
from ..operators.strategies import INPUTS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of a fold that its configuration gives, and what holds for one block alone.
GIVEN = ("c", "configs", "model", "now")


def parts_of(x: Any) -> Iterator[tuple[str, Any]]:
    """The named parts of an object, list or dictionary."""
    if isinstance(x, dict):
        yield from ((str(i), v) for i, v in enumerate(x.values()))
    elif isinstance(x, list):
        yield from ((str(i), v) for i, v in enumerate(x))
    else:
        yield from ((k, v) for k, v in vars(x).items() if k not in GIVEN)


def plain(x: Any) -> bool:
    return isinstance(x, np.ndarray) or isinstance(x, list) and all(isinstance(v, float) for v in x)


def saved(x: Any, path: str = "") -> tuple[dict[str, float], dict[str, list[float]]]:
    """The numbers and the arrays of a fold by name."""
    numbers: dict[str, float] = {}
    arrays: dict[str, list[float]] = {}
    for name, v in parts_of(x):
        at = f"{path}{name}"
        if v is None or isinstance(v, kernels.Config):
            continue
        if isinstance(v, (int, float, np.number)):
            numbers[at] = float(v)
        elif plain(v):
            arrays[at] = np.asarray(v, float).ravel().tolist()
        else:
            more = saved(v, f"{at}/")
            numbers |= more[0]
            arrays |= more[1]
    return numbers, arrays


def restored(x: Any, numbers: dict[str, float], arrays: dict[str, list[float]], path: str = "") -> Any:
    """x, new and of the same configuration, with what saved() gave."""
    if isinstance(x, kernels.Regime) and any(k.startswith(f"{path}hmm/") for k in arrays):
        x.hmm = kernels.Regimes(np.zeros(3), np.zeros(3), np.zeros((3, 3)))
    for name, v in list(parts_of(x)):
        at = f"{path}{name}"
        if isinstance(v, kernels.Config) or v is None or isinstance(v, (int, float, np.number)):
            continue
        if plain(v):
            if at in arrays:
                new = np.array(arrays[at])
                setattr(x, name, new.tolist() if isinstance(v, list) else new.reshape(v.shape) if v.ndim > 1 else new)
        else:
            restored(v, numbers, arrays, f"{at}/")
    if hasattr(x, "__dict__"):
        for at, v in numbers.items():
            name = at.removeprefix(path)
            if at.startswith(path) and "/" not in name:
                setattr(x, name, int(v) if isinstance(vars(x).get(name), int) else v)
    return x


class Folded(StatefulProcessor):
    """block(fold, bars) over each series' bars as they come; fresh() makes its first fold."""

    def __init__(self, fresh: Callable[[], Any], block: Callable[[Any, pd.DataFrame], pd.DataFrame]):
        self.fresh, self.block = fresh, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp_ntz")
        self.numbers = handle.getMapState("numbers", "name string", "value double")
        self.arrays = handle.getMapState("arrays", "name string", "values array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows)).sort_values("ts", kind="stable").drop_duplicates("ts")
        if self.last.exists():
            bars = bars[bars["ts"] > pd.Timestamp(self.last.get()[0])]
        if not len(bars):
            return
        fold = restored(self.fresh(), {k[0]: v[0] for k, v in self.numbers.iterator()}, {k[0]: list(v[0]) for k, v in self.arrays.iterator()})
        out = self.block(fold, bars)
        numbers, arrays = saved(fold)
        for k, v in numbers.items():
            self.numbers.updateValue((k,), (v,))
        for k, v in arrays.items():
            self.arrays.updateValue((k,), (v,))
        self.last.update((bars["ts"].iloc[-1].to_pydatetime(),))
        if len(out):
            out.insert(0, "symbol", key[0])
            yield out

    def close(self) -> None:
        pass


def folded(bars: DataFrame, fresh: Callable[[], Any], block: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    use_state_store(bars.sparkSession)
    return bars.groupBy("symbol").transformWithStateInPandas(statefulProcessor=Folded(fresh, block), outputStructType=schema, outputMode="Append", timeMode="None")


def use_state_store(spark: SparkSession) -> None:
    """Map states need the state store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def online_filter(bars: DataFrame, model: str, config: kernels.Config) -> DataFrame:
    """(symbol, ts, x, sigma_stat) of each bar (symbol, ts, close) as it comes, from the first calibration on."""

    def block(series: kernels.Series, rows: pd.DataFrame) -> pd.DataFrame:
        out = series.block(rows["close"].to_numpy(float))
        return pd.DataFrame({"ts": rows["ts"].to_numpy(), "x": out["x"], "sigma_stat": out["sigma_stat"]}).dropna(subset=["x"])

    return folded(bars, lambda: kernels.Series(model, config), block, "symbol string, ts timestamp_ntz, x double, sigma_stat double")


def online_signals(bars: DataFrame, model: str, config: kernels.Config) -> DataFrame:
    """(symbol, ts, idx, close, signal) of the bars (symbol, ts, open, high, low, close, volume) with an event, as they come: filter, regimes and position are state."""

    def fresh() -> kernels.Walk:
        walk = kernels.Walk(model, [config])
        walk.block({c: np.zeros(0) for c in INPUTS})  # makes its parts
        return walk

    def block(walk: kernels.Walk, rows: pd.DataFrame) -> pd.DataFrame:
        first = walk.seen
        _, [(at, names)] = walk.block({c: rows[c].to_numpy(float) for c in INPUTS})
        own = rows.iloc[at]
        return pd.DataFrame({"ts": own["ts"].to_numpy(), "idx": np.array(at, np.int64) + first, "close": own["close"].to_numpy(float), "signal": names})

    return folded(bars, fresh, block, "symbol string, ts timestamp_ntz, idx long, close double, signal string")
