"""Window expressions over a series ordered by ts: indicators and rolling calibration.

Each takes columns and the series' window parts (`by`) and gives a column, so
that all that share `by` share one sort. "Prior n" frames end one row back; a
value is null until a frame is full.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

BY = ("symbol",)


def let(x: Column, f) -> Column:
    """f(x) with x computed once: an expression that a lambda repeats is computed again for each element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def order(by: tuple[str, ...] = BY, ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(ts)


def prior(n: int, by: tuple[str, ...] = BY, ts: str = "ts") -> WindowSpec:
    return order(by, ts).rowsBetween(-n, -1)


def full(value: Column, x: Column, n: int, w: WindowSpec) -> Column:
    """value where the frame holds n values of x."""
    return F.when(F.count(x).over(w) == n, value)


def previous(x: Column, by: tuple[str, ...] = BY) -> Column:
    return F.lag(x).over(order(by))


def difference(x: Column, by: tuple[str, ...] = BY) -> Column:
    """Change from the row before; 0 at the first."""
    return F.coalesce(x - previous(x, by), F.lit(0.0))


def true_range(high: Column, low: Column, close: Column, by: tuple[str, ...] = BY) -> Column:
    before = previous(close, by)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def highest(x: Column, n: int, by: tuple[str, ...] = BY) -> Column:
    w = prior(n, by)
    return full(F.max(x).over(w), x, n, w)


def lowest(x: Column, n: int, by: tuple[str, ...] = BY) -> Column:
    w = prior(n, by)
    return full(F.min(x).over(w), x, n, w)


def mean(x: Column, n: int, by: tuple[str, ...] = BY) -> Column:
    w = prior(n, by)
    return full(F.avg(x).over(w), x, n, w)


def volatility(x: Column, n: int = 20, by: tuple[str, ...] = BY) -> Column:
    """Sample deviation of the n rows before."""
    w = prior(n, by)
    return full(F.stddev_samp(x).over(w), x, n, w)


def wick(open_: Column, high: Column, low: Column, close: Column) -> Column:
    """Share of a bar's range below its body; null without a range."""
    return F.when(high > low, (F.least(open_, close) - low) / (high - low))


def hurst(close: Column, n: int, by: tuple[str, ...] = BY) -> Column:
    """log(range / deviation) / log(n) of the last n differences (the row's own included)."""
    w = order(by).rowsBetween(-(n - 1), 0)
    # The frame's differences come from its n closes and the one before; the first row's counts as 0.
    x = F.collect_list(close).over(order(by).rowsBetween(-n, 0))
    def scaled(x: Column) -> Column:
        return let(F.transform(F.slice(x, 2, n), lambda c, i: c - F.element_at(x, i + 1)), lambda d: let(array_mean(d), lambda m: ranged(d, m)))

    def ranged(diffs: Column, m: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("at"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("low"), F.lit(0.0).alias("squares"))

        def step(a: Column, d: Column) -> Column:
            at = a["at"] + (d - m)
            return F.struct(at.alias("at"), F.greatest(a["top"], at).alias("top"), F.least(a["low"], at).alias("low"), (a["squares"] + (d - m) * (d - m)).alias("squares"))

        def last(a: Column) -> Column:
            s, r = F.sqrt(a["squares"] / n), a["top"] - a["low"]
            return F.when((s > 0) & (r > 0), F.log(r / s) / F.log(F.lit(float(n))))

        return F.aggregate(diffs, zero, step, last)

    return F.when((F.count(close).over(w) == n) & (F.size(x) == n + 1), let(x, scaled))


def ar1(close: Column, n: int, by: tuple[str, ...] = BY) -> dict[str, Column]:
    """mu, b0, b1, phi and sigma of close on its lag, over the n rows before; null until there are n.

    The residual deviation comes from the frame's moments, with the line's
    intercept as fitted and its slope held to 0.01..0.99.
    """
    w, pairs = prior(n, by), prior(n - 1, by)
    x, y = previous(close, by), close
    mu = full(F.avg(close).over(w), close, n, w)
    slope = F.covar_pop(y, x).over(pairs) / F.var_pop(F.when(y.isNotNull(), x)).over(pairs)
    b0 = F.avg(y).over(pairs) - slope * F.avg(x).over(pairs)
    phi = F.least(F.greatest(slope, F.lit(0.01)), F.lit(0.99))
    bias = F.avg(y).over(pairs) - b0 - phi * F.avg(x).over(pairs)
    var = F.var_pop(y).over(pairs) - 2 * phi * F.covar_pop(y, x).over(pairs) + phi * phi * F.var_pop(x).over(pairs) + bias * bias
    spread = F.stddev_pop(close).over(w)
    sigma = F.sqrt(F.greatest(var, F.lit(0.0)))
    ok = F.count(close).over(w) == n
    return {"mu": mu, "b0": F.when(ok, b0), "b1": F.when(ok, slope), "phi": F.when(ok, phi), "sigma": F.when(ok, F.when(sigma > 0, sigma).otherwise(F.greatest(spread * 0.01, F.lit(1e-9))))}


def velocity(close: Column, idx: Column, n: int, by: tuple[str, ...] = BY) -> Column:
    """Least-squares slope of close against its place, over the n rows before."""
    w = prior(n, by)
    return full(F.regr_slope(close, idx).over(w), close, n, w)


def frame(close: Column, n: int, by: tuple[str, ...] = BY) -> Column:
    """The n closes before, oldest first; null until there are n."""
    w = prior(n, by)
    x = F.collect_list(close).over(w)
    return F.when(F.size(x) == n, x)


def residuals(x: Column, phi: Column, mu: Column) -> Column:
    """x[i+1] - phi x[i] - (1 - phi) mu of an array."""
    return F.transform(F.slice(x, 2, F.size(x) - 1), lambda y, i: y - phi * F.element_at(x, i + 1) - (1 - phi) * mu)


def array_mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def array_std(x: Column) -> Column:
    """Population deviation."""
    return let(x, lambda v: let(array_mean(v), lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, e: a + (e - m) * (e - m)) / F.size(v))))


def cir_sigma(x: Column, phi: Column, mu: Column) -> Column:
    """Mean of squared residuals over the level before (1e-9 at least)."""
    squares = F.transform(residuals(x, phi, mu), lambda r, i: r * r / F.greatest(F.element_at(x, i + 1), F.lit(1e-9)))
    return let(array_mean(squares), lambda out: F.when(out > 0, out).otherwise(F.greatest(array_std(x) * array_std(x) * 1e-4, F.lit(1e-9))))


def jump_split(e: Column, z: float, least: int = 20, least_kept: int = 10) -> Column:
    """sigma of the residuals within z deviations, and the share beyond; of all, and 0, where either would leave too few; 1e-6 for flat ones."""

    def split(e: Column, s: Column, kept: Column) -> Column:
        whole = (F.size(e) < least) | (F.size(kept) < least_kept) | (s <= 0)
        sigma = F.when(F.when(F.size(e) < least, F.size(e) < 2).otherwise(s <= 0), F.lit(1e-6)).when(whole, s).otherwise(array_std(kept))
        return F.struct(sigma.alias("sigma"), F.when(whole, 0.0).otherwise((F.size(e) - F.size(kept)) / F.size(e)).alias("share"))

    return let(e, lambda e: let(array_std(e), lambda s: let(F.filter(e, lambda r: F.abs(r) <= z * s), lambda kept: split(e, s, kept))))


def array_percentile(x: Column, p: Column) -> Column:
    """Linear between the nearest ranks, p from 0 to 1."""

    def at(s: Column) -> Column:
        place = p * (F.size(s) - 1)
        lo = F.floor(place).cast("int")
        a, b = F.element_at(s, lo + 1), F.element_at(s, F.least(lo + 2, F.size(s)))
        return a + (b - a) * (place - lo)

    return let(F.array_sort(x), at)


def held(x: Column, idx: Column, start: int, every: int, by: tuple[str, ...] = BY) -> Column:
    """x at the last row whose place is start plus a multiple of every."""
    on = F.when((idx >= start) & ((idx - start) % every == 0), x)
    return F.last(on, ignorenulls=True).over(order(by).rowsBetween(Window.unboundedPreceding, 0))


def theta(phi: Column) -> Column:
    return -F.log(phi)


def stationary_sigma(sigma: Column, phi: Column) -> Column:
    return sigma / F.sqrt(F.greatest(2 * theta(phi), F.lit(1e-12)))


def half_life(phi: Column) -> Column:
    return F.log(F.lit(2.0)) / theta(phi)
