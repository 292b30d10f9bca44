"""Rounding and registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def r(x: Column | str, digits: int = DIGITS) -> Column:
    """Rounded, and without a negative zero: aggregation orders differ between engines."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def rounded(df: DataFrame, *keep: str, digits: int = DIGITS) -> DataFrame:
    """df with every double but `keep` rounded."""
    return df.select(*(r(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


class Area:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, sql: str | None = None):
        def register(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return register
