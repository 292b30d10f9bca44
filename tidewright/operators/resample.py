"""Bootstrap and Monte-Carlo baselines by counter-based draws.

Draw i of run b is a fixed function of (seed, salt, b, i), so runs are spread
over tasks, survive their loss, and are the same in any engine. The function
mixes 32 bits by shifts, exclusive ors and products that stay below 2**63:
each bit of a counter turns about half of the bits drawn, so draws of one run
are as good as independent, and so are those of two salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS = 1 << 32
#: Fixed values of the mixing function: shift and odd factor of each step, and the last shift.
STEPS, LAST = ((16, 0x21F0AAAD), (15, 0x735A2D97)), 15
SEED = 20240607
#: Resamples of a mean and simulations of a total, as in the walks.
BOOTSTRAP_RUNS, SIMULATIONS = 5000, 1000
#: Salts: the trade that is resampled, the place of entry, the direction.
PICK, ENTRY, WAY = 0, 1, 2


def mixed(x: int) -> int:
    """The mixing function, of one number below MODULUS."""
    for shift, factor in STEPS:
        x = (x ^ x >> shift) * factor % MODULUS
    return x ^ x >> LAST


def _mixed(x: Column) -> Column:
    for shift, factor in STEPS:
        x = (x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(factor)).bitwiseAND(F.lit(MODULUS - 1))
    return x.bitwiseXOR(F.shiftright(x, LAST))


def _mixed_sql(x: str) -> str:
    for shift, factor in STEPS:
        x = f"((xor({x}, {x} >> {shift}) * {factor}) & {MODULUS - 1})"
    return f"xor({x}, {x} >> {LAST})"


def key(salt: int, seed: int = SEED) -> int:
    return mixed(mixed(seed % MODULUS) ^ salt)


def draw(run: Column, i: Column, salt: int = PICK, seed: int = SEED) -> Column:
    """A number below MODULUS; run and i are below it too."""
    return _mixed(_mixed(run.cast("long").bitwiseXOR(F.lit(key(salt, seed)))).bitwiseXOR(i.cast("long")))


def draw_sql(run: str, i: str, salt: int = PICK, seed: int = SEED) -> str:
    inner = f"xor(CAST({run} AS BIGINT), {key(salt, seed)})"
    return _mixed_sql(f"xor({_mixed_sql(inner)}, CAST({i} AS BIGINT))")


def _runs(rows: DataFrame, runs: int) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))


def bootstrap(trades: DataFrame, by: tuple[str, ...], runs: int, value: str = "net_pnl") -> DataFrame:
    """by, n, mean, lower, upper (2.5 and 97.5 percentiles of resampled means) and p_positive."""
    n = trades.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    rows = _runs(trades.select(*by, F.col("trade_no").alias("i")).join(n.select(*by, "n"), list(by)), runs)
    drawn = rows.select(*by, "run", (draw(F.col("run"), F.col("i")) % F.col("n")).alias("trade_no"))
    means = drawn.join(trades.select(*by, "trade_no", value), [*by, "trade_no"]).groupBy(*by, "run").agg(F.avg(value).alias("m"))
    out = means.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("lower"), F.percentile("m", F.lit(0.975)).alias("upper"), F.avg((F.col("m") > 0).cast("double")).alias("p_positive"))
    return n.join(out, list(by))


def monte_carlo(trades: DataFrame, bars: DataFrame, by: tuple[str, ...], runs: int, cost: float, folds: tuple[str, ...] = (), number: str = "trade_no") -> DataFrame:
    """by, real, percentile, sim_mean, sim_std, sim_p05, sim_p95: the total against random entries.

    Every run draws for each trade a duration among the real ones (held to the
    series), an entry and a direction; bars: by, folds, idx, close. With folds,
    durations and entries are drawn within the trade's own fold and a run's
    total is that of all its folds; number then counts the trades of all folds,
    and trade_no those of one. A fold of fewer than three bars has no draws.
    """
    each = [*by, *folds]
    lengths = bars.groupBy(*each).agg(F.count("*").alias("n_bars"))
    counts = trades.groupBy(*each).agg(F.count("*").alias("n"))
    real = trades.groupBy(*by).agg(F.sum("net_pnl").alias("real"))
    base = trades.select(*each, F.col(number).alias("i")).join(counts, each).join(lengths.where("n_bars >= 3"), each)
    rows = _runs(base, runs).withColumn("trade_no", draw(F.col("run"), F.col("i")) % F.col("n"))
    rows = rows.join(trades.select(*each, "trade_no", (F.col("exit_idx") - F.col("entry_idx")).alias("real_length")), [*each, "trade_no"])
    span = F.least(F.greatest("real_length", F.lit(1)), F.col("n_bars") - 1)
    way = F.when(draw(F.col("run"), F.col("i"), WAY) >= MODULUS // 2, 1.0).otherwise(-1.0)
    rows = rows.select(*each, "run", span.alias("span"), (draw(F.col("run"), F.col("i"), ENTRY) % (F.col("n_bars") - span)).alias("idx"), way.alias("way"))
    closes = bars.select(*each, "idx", F.col("close"))
    rows = rows.join(closes, [*each, "idx"]).withColumnsRenamed({"close": "a", "idx": "entry"}).withColumn("idx", F.col("entry") + F.col("span")).join(closes, [*each, "idx"])
    totals = rows.groupBy(*by, "run").agg(F.sum(F.col("way") * (F.col("close") - F.col("a")) - cost).alias("total"))
    return totals.join(real, list(by)).groupBy(*by).agg(F.max("real").alias("real"), F.avg((F.col("total") < F.col("real")).cast("double")).alias("percentile"), F.avg("total").alias("sim_mean"), F.stddev_pop("total").alias("sim_std"), F.percentile("total", F.lit(0.05)).alias("sim_p05"), F.percentile("total", F.lit(0.95)).alias("sim_p95"))
