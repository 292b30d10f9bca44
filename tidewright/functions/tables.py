"""Strategies as SQL table functions.

After register(spark), for bars (symbol, ts, open, high, low, close, volume):

    SELECT * FROM run_ou(TABLE(bars) PARTITION BY (symbol) ORDER BY (ts), '{"window": 40, "k": 1.0}')

gives a row for each bar: symbol, ts, idx, close, the model's bands and signal.
The second argument names parameters of `kernels.Config` as JSON. Spark sorts
each partition's rows; they come in Arrow batches, and the walk's state goes
from batch to batch, so a partition is never held whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from ..operators import kernels, strategies

MODELS = ("ou", "cir", "garch", "var", "jump", "trend")


def config_of(text: str | None) -> kernels.Config:
    """A configuration from JSON; an unknown name raises."""
    given = json.loads(text or "{}")
    if unknown := set(given) - set(kernels.Config.__dataclass_fields__):
        raise ValueError(f"no such parameters: {', '.join(sorted(unknown))}")
    return kernels.Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def handler(model: str):
    names = strategies.bands(model)

    class Run:
        def __init__(self):
            self.walk: kernels.Walk | None = None

        def eval(self, bars: pa.RecordBatch, parameters: pa.Array) -> Iterator[pa.Table]:
            if not bars.num_rows:
                return
            if self.walk is None:
                self.walk = kernels.Walk(model, [config_of(parameters[0].as_py())])
            columns = [bars.column("symbol"), bars.column("ts"), *strategies.banded(self.walk, bars, names)]
            yield pa.Table.from_arrays(columns, names=["symbol", "ts", "idx", "close", *names, "signal"])

    schema = "symbol string, ts timestamp_ntz, idx bigint, close double, " + ", ".join(f"{n} double" for n in names) + ", signal string"
    return arrow_udtf(Run, returnType=schema)


def register(spark: SparkSession) -> None:
    """run_ou, run_cir, run_garch, run_var, run_jump and run_trend in a session."""
    for model in MODELS:
        spark.udtf.register(f"run_{model}", handler(model))
