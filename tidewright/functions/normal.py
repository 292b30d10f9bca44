"""The standard normal distribution as column expressions (Spark has no erf)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Acklam's rational approximation of the inverse.
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
LOW = 0.02425
EULER = 0.5772156649015329
#: Terms of the series below |x| = 6; beyond, the tail is under 1e-9.
TERMS = 60


def _poly(c: tuple[float, ...], x):
    out = c[0]
    for k in c[1:]:
        out = out * x + k
    return out


def phi(x: Column) -> Column:
    """The distribution function: 1/2 + density * (x + x^3/3 + x^5/15 + ...)."""
    x = F.least(F.greatest(x, F.lit(-8.0)), F.lit(8.0))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(x.alias("term"), x.alias("sum")),
        lambda a, i: F.struct((a["term"] * x * x / (2 * i + 1)).alias("term"), (a["sum"] + a["term"] * x * x / (2 * i + 1)).alias("sum")),
        lambda a: a["sum"],
    )
    inside = 0.5 + series * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    return F.when(x > 6, F.lit(1.0)).when(x < -6, F.lit(0.0)).otherwise(inside)


def phi_inverse(p: Column) -> Column:
    """The quantile function; null outside (0, 1)."""
    q = F.sqrt(-2 * F.log(F.when(p < 0.5, p).otherwise(1 - p)))
    tail = _poly(C, q) / (_poly(D, q) * q + 1)
    r = (p - 0.5) * (p - 0.5)
    middle = _poly(A, r) * (p - 0.5) / (_poly(B, r) * r + 1)
    return F.when((p > 0) & (p < LOW), tail).when((p >= LOW) & (p <= 1 - LOW), middle).when((p > 1 - LOW) & (p < 1), -tail)


def _poly_sql(c: tuple[float, ...], x: str) -> str:
    out = repr(c[0])
    for k in c[1:]:
        out = f"({out} * {x} + ({k!r}))"
    return out


def phi_inverse_sql(p: str) -> str:
    q, r = f"sqrt(-2 * ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END))", f"(({p} - 0.5) * ({p} - 0.5))"
    tail = f"({_poly_sql(C, q)} / ({_poly_sql(D, q)} * {q} + 1))"
    middle = f"({_poly_sql(A, r)} * ({p} - 0.5) / ({_poly_sql(B, r)} * {r} + 1))"
    return f"CASE WHEN {p} > 0 AND {p} < {LOW} THEN {tail} WHEN {p} >= {LOW} AND {p} <= {1 - LOW} THEN {middle} WHEN {p} > {1 - LOW} AND {p} < 1 THEN -{tail} END"


def phi_sql(x: str) -> str:
    """Simpson's rule over the density in 200 steps: another road than phi's series."""
    return f"""CASE WHEN {x} > 6 THEN 1.0 WHEN {x} < -6 THEN 0.0 ELSE 0.5 + {x} / 600 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 201),
      lambda i: (CASE WHEN i = 0 OR i = 200 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-({x} * i / 200) * ({x} * i / 200) / 2))) END"""
