"""Table shapes, symbol routing and the cost model."""

from __future__ import annotations

from pyspark.sql import types as T

_price = T.DecimalType(16, 5)
_bar = [
    T.StructField("price_date", T.DateType()), T.StructField("price_datetime", T.TimestampNTZType(), False),
    *(T.StructField(f"{c}_price", _price) for c in ("open", "high", "low", "close")), T.StructField("volume", T.LongType()),
]

#: Bars with and without the column that names their source; broker rates, ticks, macro values and pipeline status.
BARS = T.StructType([*_bar, T.StructField("data_source", T.StringType()), T.StructField("inserted_at", T.TimestampType())])
PLAIN_BARS = T.StructType([*_bar, T.StructField("inserted_at", T.TimestampType())])
RATES = T.StructType([
    T.StructField("time", T.TimestampNTZType()), T.StructField("time_utc", T.TimestampType()),
    *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")),
    *(T.StructField(c, T.LongType()) for c in ("tick_volume", "spread", "real_volume")),
])
TICKS = T.StructType([
    T.StructField("time", T.TimestampNTZType()), T.StructField("time_utc", T.TimestampType()),
    *(T.StructField(c, T.DoubleType()) for c in ("bid", "ask", "last")), T.StructField("volume", T.LongType()), T.StructField("flags", T.IntegerType()),
])
MACRO = T.StructType([T.StructField("report_date", T.DateType(), False), T.StructField("value", T.DecimalType(12, 6))])
STATUS = T.StructType([
    T.StructField("pipeline_name", T.StringType(), False), T.StructField("last_success_at", T.TimestampNTZType()),
    T.StructField("last_row_count", T.IntegerType()), T.StructField("last_error", T.StringType()),
])
TABLES = {"bars": BARS, "plain_bars": PLAIN_BARS, "rates": RATES, "ticks": TICKS, "macro": MACRO, "status": STATUS}

#: Database of each symbol, those that drive others and come by the hour alone, price of a pip and default cost in pips.
DATABASES = {"XAUUSD": "raw_gold", "EURUSD": "raw_eurusd", "NDX100": "raw_ndx100", "XAGUSD": "raw_silver", "USDX": "raw_dxy", "VIX": "raw_vix"}
MACRO_SYMBOLS = ("XAGUSD", "USDX", "VIX")
PIP = {"XAUUSD": 0.1, "EURUSD": 0.0001, "NDX100": 1.0}
COST_PIPS = 1.2
SECONDS = {"m5": 300, "m15": 900, "h1": 3600, "d1": 86400}


def database(symbol: str | None = None) -> str:
    """The database of a symbol (XAUUSD if none is named); a ValueError names one that has none."""
    symbol = symbol or "XAUUSD"
    if symbol not in DATABASES:
        raise ValueError(f"no database for symbol {symbol!r}; known: {', '.join(sorted(DATABASES))}")
    return DATABASES[symbol]


def timeframes(symbol: str) -> tuple[str, ...]:
    """The bars that are kept of a symbol: hours alone for those that drive others."""
    database(symbol)
    return ("h1",) if symbol in MACRO_SYMBOLS else ("m5", "m15", "h1")


def bar_schema(symbol: str) -> T.StructType:
    """The shape of a symbol's bars; those that drive others name no source."""
    database(symbol)
    return PLAIN_BARS if symbol in MACRO_SYMBOLS else BARS


def cost(symbol: str, pips: float = COST_PIPS) -> float:
    """Price units that a round trip costs."""
    return pips * PIP[symbol]
