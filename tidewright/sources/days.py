"""A table of days that batches are merged into, with one writer at a time.

Rows lie in Parquet folders by day. A commit is a small file that names the
folder of every day; it is created whole under its own number, which only one
writer can do, so readers see all of a batch or nothing. A batch rewrites the
days that it touches and leaves all other folders as they are. A batch number
that is already committed changes nothing, so a stream may run its last batch
again after a failure. Folders of a writer that died before its commit are
named by none.

A lease names the writer. Each holder gets a higher token than the one before;
a lease that has run out may be taken, and a commit needs the newest token, so
a writer that was away for too long cannot publish over its successor.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import upserted


class Taken(RuntimeError):
    """Another writer holds the lease or has committed first."""


class Folder:
    """Small files in any store that Spark reads, by Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path, self.at = path, jvm.org.apache.hadoop.fs.Path
        self.files = self.at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.mkdirs(self.at(path))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.files.listStatus(self.at(self.path)) if not s.getPath().getName().startswith("."))

    def read(self, name: str) -> dict:
        stream = self.files.open(self.at(f"{self.path}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def write(self, name: str, content: dict) -> None:
        stream = self.files.create(self.at(f"{self.path}/{name}"), True)
        stream.write(json.dumps(content).encode())
        stream.close()

    def publish(self, name: str, content: dict) -> bool:
        """Makes a file appear whole, if no one has made it; says whether it did."""
        if not self.files.createNewFile(self.at(f"{self.path}/{name}.claim")):
            return False
        own = f".{name}-{uuid.uuid4().hex}"
        self.write(own, content)
        return bool(self.files.rename(self.at(f"{self.path}/{own}"), self.at(f"{self.path}/{name}")))


class Lease:
    """The right to write, for so many seconds at a time."""

    def __init__(self, spark: SparkSession, path: str, owner: str | None = None, seconds: float = 120.0, now: Callable[[], float] = time.time):
        self.folder, self.owner, self.seconds, self.now, self.token = Folder(spark, path), owner or uuid.uuid4().hex, seconds, now, 0

    def newest(self) -> tuple[int, dict]:
        tokens = [int(n) for n in self.folder.names() if n.isdigit()]
        return (max(tokens), self.folder.read(f"{max(tokens):012d}")) if tokens else (0, {"owner": None, "until": 0.0})

    def acquire(self) -> int:
        token, held = self.newest()
        if held["owner"] not in (None, self.owner) and held["until"] > self.now():
            raise Taken(f"{held['owner']} writes until {held['until']}")
        # A claim without its lease is of a writer that died between the two: go past it.
        claims = [int(n.split(".")[0]) for n in self.folder.names() if n.endswith(".claim")]
        self.token = max([token, *claims]) + 1
        if not self.folder.publish(f"{self.token:012d}", self.content()):
            raise Taken("another writer was first")
        return self.token

    def content(self) -> dict:
        return {"owner": self.owner, "until": self.now() + self.seconds}

    def renew(self) -> None:
        self.check()
        self.folder.write(f"{self.token:012d}", self.content())

    def release(self) -> None:
        self.check()
        self.folder.write(f"{self.token:012d}", {"owner": None, "until": 0.0})

    def check(self) -> None:
        """Raises unless this is the newest holder."""
        if not self.token or self.newest()[0] != self.token:
            raise Taken("the lease has gone to another writer")


class DayTable:
    """Rows of a schema with a time column ts, merged by key; the last write wins."""

    def __init__(self, spark: SparkSession, path: str, schema, key: list[str], lease: Lease | None = None):
        self.spark, self.path, self.schema, self.key, self.lease = spark, path, schema, key, lease
        self.commits = Folder(spark, f"{path}/commits")

    def state(self) -> dict:
        """The newest commit: version, last batch and the folder of each day."""
        versions = [n for n in self.commits.names() if n.endswith(".json")]
        return self.commits.read(versions[-1]) if versions else {"version": 0, "batch": None, "days": {}}

    def rows_of(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self.rows_of(sorted(self.state()["days"].values()))

    def merge(self, batch: DataFrame, number: int) -> bool:
        """Merges a batch and publishes the result; says whether it was new."""
        before = self.state()
        if before["batch"] is not None and number <= before["batch"]:
            return False
        day = F.date_format("ts", "yyyy-MM-dd")
        days = [r["day"] for r in batch.select(day.alias("day")).distinct().collect()]  # the days of one batch
        old = [before["days"][d] for d in days if d in before["days"]]
        rows = batch if "seq" in batch.columns else batch.withColumn("seq", F.lit(number).cast("long"))
        folder = f"{self.path}/data/{before['version'] + 1:012d}-{uuid.uuid4().hex}"
        upserted(self.rows_of(old), rows, self.key).withColumn("day", day).repartition("day").write.partitionBy("day").parquet(folder)
        if self.lease:
            self.lease.renew()
        after = {"version": before["version"] + 1, "batch": number, "days": before["days"] | {d: f"{folder}/day={d}" for d in days}}
        if not self.commits.publish(f"{after['version']:012d}.json", after):
            raise Taken("another writer has committed this version")
        return True
