"""Ranges of ticks and bars as data sources of Spark: format "rates".

A scan of a time range is cut into chunks of days, one partition each, at
midnights, so a bar never lies in two. Each chunk reads only the files whose
statistics say that they have rows in it, and of these only the row groups
and columns that it needs. Bounds are options, true UTC with a zone, and reach
the files; without them the range is what the files hold. Filters are left to
Spark and not taken over by the reader: Spark 4.1 keeps one reader for all scans
of a loaded table, so a filter taken over in one query would hold in the next.

As a stream the source gives the oldest page first: a long gap is caught up
page by page. A page ends at a multiple of its length, so that pages are the
same whenever they are asked for. How far pages have been given is written
before a page is given, to the folder `progress`, which the driver must reach;
Spark's own checkpoint says which of them are done. After a restart the last
page given is offered again: it is new where Spark had not logged it, and no
change where it had, so nothing is lost or read twice.

Options: path; start, end; chunk_days (0: one chunk); timeframe (m5, m15, h1,
d1; without it ticks are given); offset_minutes, by which the broker's clock
is ahead; columns symbol_column, time_column, seq_column, price_column of the
table. A stream also takes page_minutes, overlap_minutes (which are read again
before each page, for merges by key), progress, and begin (broker time without
zone, a page's end: earlier rows are not given).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.ingest import day_ranges, parsed_time
from .schemas import SECONDS

TICKS = "symbol string, time timestamp_ntz, time_utc timestamp, seq long, price double"
RATES = "symbol string, time timestamp_ntz, time_utc timestamp, open double, high double, low double, close double, tick_volume long"
MICROS = dt.timedelta(microseconds=1)
EPOCH = dt.datetime(1970, 1, 1)


class Chunk(InputPartition):
    """A range of broker time and the files that have rows in it."""

    def __init__(self, start: dt.datetime, end: dt.datetime, files: list[str]):
        self.start, self.end, self.files = start, end, files


class Table:
    """Parquet files with the span of broker times that each holds."""

    def __init__(self, options: dict[str, str]):
        path = options["path"]
        self.filesystem, self.path = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        name = lambda key, default: options.get(f"{key}_column", default)
        self.symbol, self.time, self.seq, self.price = name("symbol", "event_type"), name("time", "ts"), name("seq", "event_id"), name("price", "value")
        self.offset = dt.timedelta(minutes=int(options.get("offset_minutes", 0)))
        self.frame = options.get("timeframe")
        if self.frame is not None and self.frame not in SECONDS:
            raise ValueError(f"no such timeframe: {self.frame!r}")
        self.known: dict[str, tuple[dt.datetime, dt.datetime] | None] = {}

    def spans(self) -> dict[str, tuple[dt.datetime, dt.datetime]]:
        """First and last time of each file with rows, from its footer; a footer is read once."""
        found = self.filesystem.get_file_info(pafs.FileSelector(self.path, recursive=True, allow_not_found=True)) if self.filesystem.get_file_info(self.path).type == pafs.FileType.Directory else [self.filesystem.get_file_info(self.path)]
        for f in found:
            if f.type == pafs.FileType.File and f.path not in self.known and not f.base_name.startswith(("_", ".")):
                self.known[f.path] = self.span(f.path)
        return {f: s for f, s in self.known.items() if s}

    def span(self, file: str) -> tuple[dt.datetime, dt.datetime] | None:
        meta = pq.read_metadata(file, filesystem=self.filesystem)
        at = meta.schema.to_arrow_schema().get_field_index(self.time)
        groups = [g for g in (meta.row_group(i) for i in range(meta.num_row_groups)) if g.num_rows]
        stats = [g.column(at).statistics for g in groups]
        if all(s is not None and s.has_min_max for s in stats):
            return (min(s.min for s in stats), max(s.max for s in stats)) if stats else None
        times = pq.read_table(file, columns=[self.time], filesystem=self.filesystem).column(self.time)
        return (pc.min(times).as_py(), pc.max(times).as_py()) if len(times) > times.null_count else None

    def chunks(self, ranges: Iterable[tuple[dt.datetime, dt.datetime]]) -> list[Chunk]:
        """A chunk for each range of broker time that any file has rows in."""
        spans = self.spans()
        out = [Chunk(a, b, [f for f, (lo, hi) in spans.items() if lo < b and hi >= a]) for a, b in ranges]
        return [c for c in out if c.files]

    def read(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        files = ds.dataset(chunk.files, format="parquet", filesystem=self.filesystem)
        columns = {"symbol": ds.field(self.symbol), "time": ds.field(self.time), "seq": ds.field(self.seq), "price": ds.field(self.price)}
        kind = files.schema.field(self.time).type

        def rows(a: dt.datetime, b: dt.datetime) -> ds.Scanner:
            inside = (ds.field(self.time) >= pa.scalar(a, kind)) & (ds.field(self.time) < pa.scalar(b, kind))
            return files.scanner(columns=columns, filter=inside)

        if not self.frame:
            for b in rows(chunk.start, chunk.end).to_batches():
                if b.num_rows:
                    yield self.shaped(pa.table(b), ["seq", "price"], (pa.int64(), pa.float64()))
            return
        # A day at once: the bars of one are all that a task holds.
        for a, b in cut(chunk.start, chunk.end, 1):
            table = rows(a, b).to_table()
            if table.num_rows:
                yield self.shaped(self.bars(table), ["open", "high", "low", "close", "tick_volume"], (*[pa.float64()] * 4, pa.int64()))

    def bars(self, ticks: pa.Table) -> pa.Table:
        ticks = ticks.sort_by([("symbol", "ascending"), ("time", "ascending"), ("seq", "ascending")])
        ticks = ticks.set_column(1, "time", pc.floor_temporal(ticks.column("time"), SECONDS[self.frame], "second"))
        made = ticks.group_by(["symbol", "time"], use_threads=False).aggregate([("price", f) for f in ("first", "max", "min", "last", "count")])
        return made.rename_columns({"price_first": "open", "price_max": "high", "price_min": "low", "price_last": "close", "price_count": "tick_volume"})

    def shaped(self, table: pa.Table, rest: list[str], kinds: Sequence[pa.DataType]) -> pa.RecordBatch:
        time = table.column("time").cast(pa.timestamp("us"))
        utc = pc.subtract(time, pa.scalar(self.offset, pa.duration("us"))).cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
        columns = [table.column("symbol").cast(pa.string()), time, utc, *(table.column(c).cast(k) for c, k in zip(rest, kinds, strict=True))]
        return pa.Table.from_arrays(columns, names=["symbol", "time", "time_utc", *rest]).combine_chunks().to_batches()[0]


def cut(start: dt.datetime, end: dt.datetime, days: int) -> list[tuple[dt.datetime, dt.datetime]]:
    """[start, end) cut at every so many midnights from that before start; days of 0: in one."""
    if not start < end:
        return []
    whole = day_ranges(start.replace(hour=0, minute=0, second=0, microsecond=0), end, days) if days else [(start, end)]
    return [(max(a, start), b) for a, b in whole]


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.table, self.days = Table(options), int(options.get("chunk_days", 0))
        # Bounds as broker time.
        self.start, self.end = (None if options.get(k) is None else self.broker(parsed_time(options[k])) for k in ("start", "end"))

    def broker(self, utc: dt.datetime) -> dt.datetime:
        return utc.astimezone(dt.timezone.utc).replace(tzinfo=None) + self.table.offset

    def partitions(self) -> Sequence[InputPartition]:
        spans = self.table.spans().values()
        if not spans:
            return [Chunk(EPOCH, EPOCH, [])]
        start = max(self.start or dt.datetime.min, min(a for a, _ in spans))
        end = min(self.end or dt.datetime.max, max(b for _, b in spans) + MICROS)
        return self.table.chunks(cut(start, end, self.days)) or [Chunk(EPOCH, EPOCH, [])]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        return self.table.read(partition) if partition.files else iter(())


class PageReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.table, self.days = Table(options), int(options.get("chunk_days", 0))
        self.page = dt.timedelta(minutes=int(options["page_minutes"]))
        self.overlap = dt.timedelta(minutes=int(options.get("overlap_minutes", 0)))
        if self.table.frame and (self.page % dt.timedelta(seconds=SECONDS[self.table.frame]) or self.overlap % dt.timedelta(seconds=SECONDS[self.table.frame])):
            raise ValueError("a page and its overlap must be whole bars")
        progress = options["progress"]
        self.store, self.folder = pafs.FileSystem.from_uri(progress) if "://" in progress else (pafs.LocalFileSystem(), progress)
        self.asked = False
        self.begin = dt.datetime.fromisoformat(options["begin"]) if "begin" in options else None

    def given(self) -> dt.datetime | None:
        """How far pages have been given."""
        info = self.store.get_file_info(f"{self.folder}/given")
        if info.type != pafs.FileType.File:
            return None
        with self.store.open_input_file(info.path) as f:
            return at_micros(int(f.read()))

    def give(self, until: dt.datetime) -> None:
        self.store.create_dir(self.folder, recursive=True)
        with self.store.open_output_stream(f"{self.folder}/given.new") as f:
            f.write(str(micros(until)).encode())
        self.store.move(f"{self.folder}/given.new", f"{self.folder}/given")

    def initialOffset(self) -> dict:
        if self.begin is not None:
            return {"until": micros(self.begin)}
        spans = self.table.spans().values()
        return {"until": micros(self.floor(min((a for a, _ in spans), default=EPOCH)))}

    def floor(self, t: dt.datetime) -> dt.datetime:
        return t - (t - EPOCH) % self.page

    def latestOffset(self) -> dict:
        at, asked, self.asked = self.given(), self.asked, True
        if at is not None and not asked:
            return {"until": micros(at)}  # after a restart: the last page once more
        at = max(filter(None, (at, self.begin)), default=None)
        later = [(max(a, at or a), b) for a, b in self.table.spans().values() if at is None or b >= at]
        if not later:
            return {"until": micros(at)} if at else self.initialOffset()
        # Only pages that are over are given; stretches without rows are passed over.
        newest = self.floor(max(b for _, b in later))
        until = min(self.floor(min(a for a, _ in later)) + self.page, newest)
        if at is not None and until <= at:
            return {"until": micros(at)}
        self.give(until)
        return {"until": micros(until)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        a, b = at_micros(start["until"]), at_micros(end["until"])
        return self.table.chunks(cut(a - self.overlap, b, self.days)) if a < b else []

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        return self.table.read(partition)


def micros(t: dt.datetime) -> int:
    return (t - EPOCH) // MICROS


def at_micros(n: int) -> dt.datetime:
    return EPOCH + n * MICROS


class RateSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rates"

    def schema(self) -> str:
        return RATES if self.options.get("timeframe") else TICKS

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options))

    def streamReader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(RateSource)
