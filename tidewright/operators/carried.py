"""Folds over sorted rows whose state goes from batch to batch.

Rows are dealt by series and sorted there by Spark, which spills; Python sees
Arrow batches in order and holds one batch and one series' state, whatever the
series' length. Series (and folds, segments, windows of them) run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys to so many tasks that the few, small but costly groups do not meet in one; adaptive execution would join such partitions again."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def runs(batch: pa.RecordBatch, by: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The stretches of a sorted batch that have one key."""
    n = batch.num_rows
    new = np.zeros(max(n - 1, 0), bool)
    for c in by:
        a, b = batch.column(c).slice(1), batch.column(c).slice(0, max(n - 1, 0))
        new |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), n]
    return (batch.slice(i, j - i) for i, j in zip(edges[:-1], edges[1:], strict=True) if j > i)


def numbers(batch: pa.RecordBatch, columns: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Columns as floating-point arrays; nulls are NaN."""
    return {c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns}


def carried(rows: DataFrame, by: tuple[str, ...], order: str, start: Callable[[tuple], Any], step: Callable[[Any, pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """step(state, batch) over the rows of each key in order; start(key) makes its first state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for part in runs(batch, by):
                own = tuple(part.column(c)[0].as_py() for c in by)
                if state is None or own != key:
                    key, state = own, start(own)
                out = step(state, part)
                if out is not None and out.num_rows:
                    yield out

    return spread(rows, *by).sortWithinPartitions(*by, order).mapInArrow(run, schema)
