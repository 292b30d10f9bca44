"""Rolling walk-forward folds: train on one span, test on the next, step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86400


def _seconds(c: str):
    return F.unix_seconds(F.col(c).cast("timestamp"))


def spans(bars: DataFrame, train_days: int, test_days: int, step_days: int | None = None) -> DataFrame:
    """(symbol, start, n_folds): folds whose test ends by the last bar."""
    step, need = (step_days or test_days) * DAY, (train_days + test_days) * DAY
    ends = bars.groupBy("symbol").agg(F.min("ts").alias("start"), F.max("ts").alias("last"))
    span = _seconds("last") - _seconds("start")
    return ends.select("symbol", "start", F.when(span >= need, F.floor((span - need) / step) + 1).otherwise(0).cast("int").alias("n_folds"))


def make_folds(bars: DataFrame, train_days: int, test_days: int, step_days: int | None = None) -> DataFrame:
    """(symbol, fold, train_start, train_end, test_end)."""
    step = (step_days or test_days)
    rows = spans(bars, train_days, test_days, step_days).where("n_folds > 0").select("symbol", "start", F.explode(F.sequence(F.lit(0), F.col("n_folds") - 1)).alias("fold"))
    at = lambda days: F.col("start") + F.make_dt_interval(F.col("fold") * step + F.lit(days))
    return rows.select("symbol", "fold", at(0).alias("train_start"), at(train_days).alias("train_end"), at(train_days + test_days).alias("test_end"))


def fold_bars(bars: DataFrame, train_days: int, test_days: int, step_days: int | None = None) -> DataFrame:
    """bars with fold and segment (train or test), a row for each fold that a bar is in.

    The folds of a bar follow from its distance to the start, so no range is
    joined: each bar makes as many rows as it has folds.
    """
    step, need = (step_days or test_days) * DAY, (train_days + test_days) * DAY
    rows = bars.join(spans(bars, train_days, test_days, step_days), "symbol")
    off = _seconds("ts") - _seconds("start")
    lo, hi = F.greatest(F.floor((off - need) / step) + 1, F.lit(0)), F.least(F.floor(off / step), F.col("n_folds") - 1)
    rows = rows.select(*bars.columns, off.alias("__off"), F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))).alias("fold"))
    segment = F.when(F.col("__off") - F.col("fold") * step < train_days * DAY, "train").otherwise("test")
    return rows.select(*bars.columns, F.col("fold").cast("int").alias("fold"), segment.alias("segment"))
