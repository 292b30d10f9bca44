"""Smoothing of one long series by blocks of time.

A step of exponential smoothing is an affine map of the value before, and the
steps of a block compose to one affine map. So blocks are worked on in
parallel: within a block a running sum of the inputs, weighted by powers of the
decay, gives each row's value up to what the block begins with; the few maps,
one row for each block, are followed through in order; and each block applies
what it begins with. No task holds or sorts a series: the largest group is a
block, and what is in order is one row for each block.

Weights grow by 1 / (1 - alpha) a row within a block, so a block's rows times
-log(1 - alpha) must stay below LOG_RANGE; blocks of BLOCK_ROWS rows do so for
any alpha up to 0.9. Rows with a null input are left out and do not age the
mean; `recursive` takes such gaps into account, row by row.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .carried import carried, numbers

BLOCK_ROWS, LOG_RANGE = 256, 600.0


def seconds(ts: str = "ts") -> Column:
    """Seconds since 1970 of a time without zone, whatever the session's zone is."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def blocked(rows: DataFrame, step_seconds: int) -> DataFrame:
    """rows with their block of time, of BLOCK_ROWS steps."""
    return rows.withColumn("__block", F.floor(seconds() / (step_seconds * BLOCK_ROWS)))


def with_previous(rows: DataFrame, columns: dict[str, str], step_seconds: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """rows with other rows' columns (name: new name) of the row before; a block's first row takes them from the block before."""
    own = blocked(rows, step_seconds)
    key = [*by, "__block"]
    ends = own.groupBy(*key).agg(F.max_by(F.struct(*columns), "ts").alias("__end"))
    ends = ends.withColumn("__before", F.lag("__end").over(Window.partitionBy(*by).orderBy("__block"))).drop("__end")
    w = Window.partitionBy(*key).orderBy("ts")
    inside = F.lag(F.struct(*columns)).over(w)
    out = own.withColumn("__inside", inside).join(ends, key, "left")
    return out.select(*rows.columns, *(F.coalesce(F.col("__inside")[c], F.col("__before")[c]).alias(new) for c, new in columns.items()))


def ewm(rows: DataFrame, columns: dict[str, str], alpha: float, step_seconds: int, warmup: int = 0, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """rows with columns (name: new name) smoothed from the first value on; null before `warmup` values."""
    if -math.log1p(-alpha) * BLOCK_ROWS > LOG_RANGE:
        raise ValueError(f"alpha {alpha} decays too fast for blocks of {BLOCK_ROWS} rows")
    key, keep = [*by, "__block"], 1 - alpha
    w = Window.partitionBy(*key).orderBy("ts")
    own = blocked(rows.dropna(subset=list(columns)), step_seconds).withColumn("__k", F.row_number().over(w))
    sums = {c: F.sum(alpha * F.col(c) * F.pow(F.lit(1 / keep), F.col("__k"))).over(w).alias(f"__s{i}") for i, c in enumerate(columns)}
    own = own.select("*", *sums.values())
    ends = [F.count("*").alias("__n")]
    for i, c in enumerate(columns):
        ends += [F.max_by(f"__s{i}", "__k").alias(f"__e{i}"), F.min_by(F.col(c).cast("double"), "__k").alias(f"__f{i}")]
    maps = own.groupBy(*key).agg(*ends)
    places = range(len(columns))
    kinds = {f.name: f.dataType.simpleString() for f in maps.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", __n0 long" + "".join(f", __y{i} double" for i in places)

    def step(state: dict, b: pa.RecordBatch) -> pa.RecordBatch:
        x = numbers(b, ("__n", *(f"__{p}{i}" for p in "ef" for i in places)))
        before, begin = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, len(columns)))
        for r in range(b.num_rows):
            if not state:
                # (1 - alpha) y + alpha x is x, the first value, for y = x.
                state |= {"n": 0, "y": [x[f"__f{i}"][r] for i in places]}
            before[r], begin[r] = state["n"], state["y"]
            decay = keep ** x["__n"][r]
            state |= {"n": state["n"] + int(x["__n"][r]), "y": [decay * (y + x[f"__e{i}"][r]) for i, y in enumerate(state["y"])]}
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in key), pa.array(before), *(pa.array(begin[:, i]) for i in places)], names=[*key, "__n0", *(f"__y{i}" for i in places)])

    begins = carried(maps, by, "__block", lambda _: {}, step, schema)
    out = own.join(begins, key)
    seen = F.col("__n0") + F.col("__k") >= warmup
    return out.select(*rows.columns, *(F.when(seen, F.pow(F.lit(keep), F.col("__k")) * (F.col(f"__y{i}") + F.col(f"__s{i}"))).alias(new) for i, new in enumerate(columns.values())))


def true_range(rows: DataFrame, step_seconds: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """rows with __tr, and __up and __down, the directional movements."""
    x = with_previous(rows, {"close": "__close", "high": "__high", "low": "__low"}, step_seconds, by)
    up, down = F.col("high") - F.col("__high"), F.col("__low") - F.col("low")
    plus, minus = F.when((up > down) & (up > 0), up).otherwise(0.0), F.when((down > up) & (down > 0), down).otherwise(0.0)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("__close")), F.abs(F.col("low") - F.col("__close")))
    return x.select(*rows.columns, tr.alias("__tr"), plus.alias("__up"), minus.alias("__down"))


def atr(rows: DataFrame, step_seconds: int, n: int = 14, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """rows with the average true range."""
    return ewm(true_range(rows, step_seconds, by), {"__tr": "atr"}, 1 / n, step_seconds, n, by).select(*rows.columns, "atr")


def adx(rows: DataFrame, step_seconds: int, n: int = 14, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The rows that have a directional index, with its mean adx (null before n of them)."""
    x = ewm(true_range(rows, step_seconds, by), {"__up": "__plus", "__down": "__minus"}, 1 / n, step_seconds, n, by)
    both = F.col("__plus") + F.col("__minus")
    x = x.select(*rows.columns, F.when(both > 0, 100 * F.abs(F.col("__plus") - F.col("__minus")) / both).alias("__dx"))
    return ewm(x, {"__dx": "adx"}, 1 / n, step_seconds, n, by).select(*rows.columns, "adx")


def moving_sum(rows: DataFrame, value: str, n: int, out: str, at: str, tie: str, by: tuple[str, ...] = (), block_hours: int = 24) -> DataFrame:
    """rows with the sum of a decimal over each row and the n - 1 before it by (at, tie), nulls last; null where all of them are null.

    Blocks of time are worked on in parallel. Counts of rows by hour tell which
    hours hold a block's n - 1 rows before; these go to that block as well.
    Within a block a row's sum is the difference of two running sums, so work
    does not grow with n. No task holds a series: what is in order is one row
    for each hour.
    """
    hour = F.coalesce(F.floor(seconds(at) / 3600), F.lit(1 << 40))
    own = rows.withColumns({"__hour": hour, "__block": F.floor(hour / block_hours)})
    same = [F.col(c) for c in (*by, "__hour")]
    w = Window.partitionBy(*by).orderBy("__hour")
    hours = own.groupBy(*same, "__block").agg(F.count("*").alias("__n")).withColumn("__upto", F.sum("__n").over(w))
    following = F.lead("__block").over(w)
    hours = hours.withColumn("__next", F.when(following > F.col("__block"), following))
    # An hour is needed by each later block before which fewer than n - 1 rows come after it.
    near = Window.partitionBy(*by).orderBy("__upto").rangeBetween(0, n - 2)
    hours = hours.withColumn("__more", F.collect_list("__next").over(near)).where(F.size("__more") > 0)
    # Written, so that Spark knows its size: it is sent to all tasks only if that is small.
    hours = written(hours.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate((*by, "__hour"))), "__more"), "hours")
    met = reduce(lambda a, b: a & b, (c.eqNullSafe(hours[f"__{i}"]) for i, c in enumerate(same)))
    dealt = own.join(hours, met, "left").select(*rows.columns, F.col("__block").alias("__own"), F.explode(F.concat(F.array("__block"), F.coalesce("__more", F.array().cast("array<bigint>")))).alias("__block"))
    w = Window.partitionBy(*by, "__block").orderBy(F.col(at).asc_nulls_last(), F.col(tie).asc_nulls_last())
    dealt = dealt.withColumns({"__sum": F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)), "__some": F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    less = lambda c: F.col(c) - F.lag(c, n, 0).over(w)
    dealt = dealt.withColumns({out: less("__sum"), "__some": less("__some")}).where("__own = __block")
    return dealt.select(*rows.columns, F.when(F.col("__some") > 0, F.col(out)).alias(out))
