"""Bars and merges over streams of ticks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import ingest
from ..sources import store


def files(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they come; with per_trigger at most so many at once: a long gap is caught up from its oldest files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def closed_bars(ticks: DataFrame, step: str, late: str = "10 minutes") -> DataFrame:
    """Bars of (symbol, ts, seq, price); a bar leaves once the watermark is past its end, so none is half formed."""
    rows = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    at, first = F.window("ts", step), F.struct("ts", "seq")
    bars = rows.groupBy("symbol", at.alias("w")).agg(F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", first).alias("close"), F.count("*").alias("volume"))
    return bars.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def without_repeats(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (symbol, seq) once, as far as repeats come within the watermark."""
    return ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "seq"])


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into Parquet, and reads that; restarts go on from the checkpoint."""
    spark = stream.sparkSession
    out, state = store.fresh(spark, name), store.fresh(spark, f"{name}-state")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def poll(stream: DataFrame, handle: Callable[[DataFrame, int], None], state: str, seconds: int | None = 60):
    """Micro-batches to a function, every so many seconds, or once over what is there."""
    trigger = {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", state).trigger(**trigger).start()


class Freshness(StreamingQueryListener):
    """Last success, rows and error of each query, by name."""

    def __init__(self):
        self.status: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.status.setdefault(event.name or str(event.id), {"last_error": None, "last_row_count": None, "last_success_at": None})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.status[p.name or str(p.id)] = {"last_error": None, "last_row_count": p.numInputRows, "last_success_at": p.timestamp}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            for known in self.status.values():
                known["last_error"] = event.exception[: ingest.ERROR_CHARS]


def with_retries(start: Callable[[], object], tries: int = 5, first_wait: float = 2.0, sleep: Callable[[float], None] | None = None):
    """start(), again after 2, 4, 8 ... seconds if it fails; the last failure is raised."""
    import time

    for k in range(tries):
        try:
            return start()
        except Exception:
            if k == tries - 1:
                raise
            (sleep or time.sleep)(first_wait * 2**k)
    return None
