"""Chart rows as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Place, colour, shape and text of a short, a long and an exit.
SHORT = ("aboveBar", "#ef5350", "arrowDown", "SHORT")
LONG = ("belowBar", "#26a69a", "arrowUp", "LONG")
EXIT = ("inBar", "#787b86", "circle", "exit")


def marker(ts: Column, signal: Column) -> Column:
    """The JSON marker of a signal; null without one."""

    def one(kind: tuple[str, ...]) -> Column:
        return F.struct(F.unix_seconds(ts.cast("timestamp")).alias("time"), *(F.lit(v).alias(k) for k, v in zip(("position", "color", "shape", "text"), kind, strict=True)))

    return F.to_json(F.when(signal == "short", one(SHORT)).when(signal == "long", one(LONG)).when(signal.isNotNull(), one(EXIT)))
