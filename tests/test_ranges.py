"""The range source in batch and as a stream."""

import datetime as dt
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF as SMALL
from pyspark.sql import functions as F

from tidewright.sources import ranges

SF = SMALL.replace("sf0.001", "sf0.01")
START = dt.datetime(2024, 1, 1)


def rates(spark, path=f"{SF}/events.parquet", **options):
    ranges.register(spark)
    return spark.read.format("rates").options(path=path, **options)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("frame", [None, "h1"])
def test_chunks_change_nothing(spark, frame):
    options = {"timeframe": frame} if frame else {}
    whole = rates(spark, **options).load()
    want = rows_of(whole)
    span = {t.date() for t in (r["time"] for r in whole.collect())}
    for days in (1, 3, 1000):
        cut = rates(spark, chunk_days=days, **options).load()
        assert rows_of(cut) == want
        assert cut.rdd.getNumPartitions() == -(-((max(span) - min(span)).days + 1) // days)
    assert len(want) == (spark.read.parquet(f"{SF}/events.parquet").count() if frame is None else len({(r[0], r[1]) for r in want}))


def test_bounds(spark):
    a, b = "2024-01-03T05:30:00+00:00", "2024-01-06T01:00:00+02:00"
    got = rates(spark, start=a, end=b, chunk_days=1).load()
    lo, hi = dt.datetime(2024, 1, 3, 5, 30), dt.datetime(2024, 1, 5, 23)
    ticks = [(r["event_type"], r["ts"], r["event_id"]) for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    assert sorted((r["symbol"], r["time"], r["seq"]) for r in got.collect()) == sorted(t for t in ticks if lo <= t[1] < hi)
    # The broker's clock is two hours ahead: the same times of the table are other true times.
    ahead = rates(spark, start=a, end=b, offset_minutes=120).load().collect()
    two = dt.timedelta(hours=2)
    assert sorted((r["symbol"], r["time"], r["seq"]) for r in ahead) == sorted(t for t in ticks if lo + two <= t[1] < hi + two)
    for bad in ({"start": "2024-01-03T00:00:00"}, {"end": "2024-01-03"}, {"timeframe": "h2"}):
        with pytest.raises(Exception, match="zone|timeframe"):
            rates(spark, **bad).load().collect()
    assert rates(spark, start="2030-01-01T00:00:00+00:00").load().count() == 0


def test_filters_hold_in_their_own_query(spark):
    df = rates(spark, chunk_days=1).load()
    n = df.count()
    one = df.where(F.col("time_utc") < F.lit("2024-01-06T00:00:00Z").cast("timestamp"))
    assert 0 < one.count() < n and df.count() == n
    narrow = rates(spark, chunk_days=1, end="2024-01-06T00:00:00Z").load()
    assert rows_of(narrow) == rows_of(one) and narrow.rdd.getNumPartitions() == 5 < df.rdd.getNumPartitions()


def write(folder, name, minutes):
    ts = [START + dt.timedelta(minutes=m) for m in minutes]
    n = len(ts)
    pq.write_table(pa.table({"event_type": ["a"] * n, "ts": pa.array(ts, pa.timestamp("us")), "event_id": list(minutes), "value": [float(m) for m in minutes]}), f"{folder}/{name}.parquet")


def started(spark, options, batches, state):
    def keep(batch, number):
        batches[number] = sorted(r["seq"] for r in batch.collect())

    return spark.readStream.format("rates").options(**options).load().writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(processingTime="0 seconds").start()


def until(query, batches, n):
    end = time.time() + 90
    while sum(map(len, batches.values())) < n:
        assert query.exception() is None and time.time() < end
        time.sleep(0.05)


def test_stream_catches_up_by_pages(spark, tmp_path):
    ranges.register(spark)
    src, state, batches = str(tmp_path / "src"), str(tmp_path / "state"), {}
    (tmp_path / "src").mkdir()
    options = {"path": src, "page_minutes": "60", "progress": str(tmp_path / "progress")}
    # Ten hours, then an empty day, then pages that are over and one that is not.
    write(src, "one", range(0, 600, 7))
    write(src, "two", [*range(2000, 2100, 9), 2170, 2219])
    want = [*range(0, 600, 7), *range(2000, 2100, 9)]
    for n in (20, 50, len(want)):  # stopped in the middle and started again
        query = started(spark, options, batches, state)
        until(query, batches, n)
        query.stop()
    rows = [s for _, page in sorted(batches.items()) for s in page]
    assert rows == want
    assert all(len({s // 60 for s in page}) <= 1 for page in batches.values())
    # New rows, a restart, and a restart with nothing new.
    write(src, "three", range(2220, 2400, 11))
    want += [2170, 2219, *[m for m in range(2220, 2400, 11) if m < 2340]]
    for _ in range(2):
        query = started(spark, options, batches, state)
        until(query, batches, len(want))
        time.sleep(0.5)
        query.stop()
    assert [s for _, page in sorted(batches.items()) for s in page] == want


def test_stream_needs_whole_bars(spark, tmp_path):
    with pytest.raises(ValueError):
        ranges.PageReader({"path": f"{SF}/events.parquet", "page_minutes": "7", "timeframe": "m5", "progress": str(tmp_path)})
