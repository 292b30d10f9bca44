"""The table of days: atomic merges of touched days, one writer, and the way from empty to a stream."""

import datetime as dt
import hashlib
import time
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewright.sources import days
from tidewright.streaming import follow

START = dt.datetime(2024, 3, 1)


def batch(spark, rows):
    """(day, hour, close) of one symbol."""
    return spark.createDataFrame([("a", START + dt.timedelta(days=d, hours=h), x, x, x, x, 1) for d, h, x in rows], follow.BARS)


def held(table):
    return sorted((r["ts"], r["close"]) for r in table.read().collect())


def prints(folder):
    return {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(folder).rglob("*.parquet")}


def test_merges_touch_their_days_alone(spark, tmp_path):
    table = days.DayTable(spark, f"{tmp_path}/t", follow.BARS, ["symbol", "ts"])
    assert table.read().count() == 0
    assert table.merge(batch(spark, [(0, 1, 1.0), (0, 2, 2.0), (1, 1, 3.0), (2, 5, 4.0)]), 0)
    first, before = prints(tmp_path / "t" / "data"), table.state()
    assert table.merge(batch(spark, [(1, 1, 30.0), (1, 2, 5.0)]), 1)
    after = table.state()
    assert {d for d in after["days"] if after["days"][d] != before["days"].get(d)} == {"2024-03-02"}
    assert first.items() <= prints(tmp_path / "t" / "data").items()  # nothing is rewritten in place
    at = lambda d, h: START + dt.timedelta(days=d, hours=h)
    want = [(at(0, 1), 1.0), (at(0, 2), 2.0), (at(1, 1), 30.0), (at(1, 2), 5.0), (at(2, 5), 4.0)]
    assert held(table) == want
    # A replayed batch, and another object over the same folder.
    files = prints(tmp_path / "t")
    assert not table.merge(batch(spark, [(1, 1, 99.0)]), 1) and prints(tmp_path / "t") == files
    again = days.DayTable(spark, f"{tmp_path}/t", follow.BARS, ["symbol", "ts"])
    assert held(again) == want and again.merge(batch(spark, [(3, 0, 7.0)]), 2) and len(held(table)) == 6


def test_a_batch_without_commit_is_not_seen(spark, tmp_path, monkeypatch):
    table = days.DayTable(spark, f"{tmp_path}/t", follow.BARS, ["symbol", "ts"])
    table.merge(batch(spark, [(0, 1, 1.0)]), 0)
    with monkeypatch.context() as m:
        m.setattr(days.Folder, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.merge(batch(spark, [(0, 1, 2.0)]), 1)
    assert [x for _, x in held(table)] == [1.0]
    assert table.merge(batch(spark, [(0, 1, 3.0)]), 1) and [x for _, x in held(table)] == [3.0]


def test_one_writer(spark, tmp_path):
    clock = [1000.0]
    lease = lambda owner: days.Lease(spark, f"{tmp_path}/lease", owner, 60, lambda: clock[0])
    one, two = lease("one"), lease("two")
    assert one.acquire() == 1
    with pytest.raises(days.Taken):
        two.acquire()
    clock[0] += 50
    one.renew()
    clock[0] += 50
    with pytest.raises(days.Taken):
        two.acquire()
    clock[0] += 20  # the first is gone for too long
    assert two.acquire() == 2
    first, second = (days.DayTable(spark, f"{tmp_path}/t", follow.BARS, ["symbol", "ts"], x) for x in (one, two))
    with pytest.raises(days.Taken):
        first.merge(batch(spark, [(0, 1, 1.0)]), 0)
    assert second.merge(batch(spark, [(0, 1, 2.0)]), 0) and [x for _, x in held(first)] == [2.0]
    two.release()
    assert one.acquire() == 3
    # Two at once: only one of them makes the token.
    assert one.folder.publish("000000000004", one.content()) and not two.folder.publish("000000000004", two.content())


def write(folder, name, minutes):
    ts = [START + dt.timedelta(minutes=m) for m in minutes]
    n = len(ts)
    pq.write_table(pa.table({"event_type": ["a"] * n, "ts": pa.array(ts, pa.timestamp("us")), "event_id": list(minutes), "value": [float(m) for m in minutes]}), f"{folder}/{name}.parquet")


def test_from_empty_to_a_stream(spark, tmp_path):
    (tmp_path / "src").mkdir()
    options = {"path": str(tmp_path / "src"), "timeframe": "m5", "page_minutes": "60", "chunk_days": "1", "progress": str(tmp_path / "progress")}
    write(tmp_path / "src", "one", range(0, 4000, 3))
    table = days.DayTable(spark, f"{tmp_path}/t", follow.BARS, ["symbol", "ts"], days.Lease(spark, f"{tmp_path}/lease"))
    table.lease.acquire()

    def bars(until):
        return [START + dt.timedelta(minutes=m) for m in range(0, until, 5)]

    def wait(query, until):
        end = time.time() + 90
        while [t for t, _ in held(table)] != bars(until):
            assert query.exception() is None and time.time() < end, len(held(table))
            time.sleep(0.3)

    query = follow.follow(spark, table, options, str(tmp_path / "state"), 1)
    assert [t for t, _ in held(table)] == bars(3960) and table.state()["batch"] == 0
    write(tmp_path / "src", "two", range(4001, 4300, 3))
    wait(query, 4260)
    query.stop()
    write(tmp_path / "src", "three", range(4300, 4500, 3))
    query = follow.follow(spark, table, options, str(tmp_path / "state"), 1)
    wait(query, 4440)
    query.stop()
    got = table.read().groupBy("ts").count().agg(F.max("count"), F.count("*")).first()
    assert tuple(got) == (1, 4440 // 5)
    assert table.read().agg(F.sum("volume")).first()[0] == sum(m < 4440 for r in (range(0, 4000, 3), range(4001, 4300, 3), range(4300, 4500, 3)) for m in r)
