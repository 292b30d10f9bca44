"""Helpers shared by the training-data operators.

Every operator selects the columns it needs by name, so further columns of a
table, whatever their names, never meet its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text that a task works on at once (a longer text is worked on alone).
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a fresh local one in local mode, else an error."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """df written to the shared folder as a table bucketed by a column, which joins and groups by it read without a shuffle."""
    spark = df.sparkSession
    own = f"tidewright_{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").options(compression="zstd", path=f"{shared_dir(spark)}/{own}").bucketBy(n, column).saveAsTable(own)
    return spark.table(own)


#: Bits of a filter for each key and, as a power of 2, in one of its maps and at most in all (8 MB).
BITS_A_KEY, MAP_BITS, MOST_BITS = 16, 15, 26


def met_by(rows: DataFrame, keys: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """rows with __met: true where keys (by) have the row's own, and by chance for a few others; false where they have not.

    One hash of each key sets a bit; the maps of bits, of bounded size whatever
    the number of keys, are sent to all tasks. So rows that no key meets are
    told without a shuffle; those that are met are left to an exact join.
    """
    bits = min(max((BITS_A_KEY * keys.count()).bit_length(), MAP_BITS), MOST_BITS)
    place = F.xxhash64(*by).bitwiseAND(F.lit((1 << bits) - 1))
    part, at = F.shiftright("__place", MAP_BITS), F.col("__place").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    maps = keys.select(place.alias("__place")).select(part.alias("__part"), at.alias("__at")).repartition("__part").groupBy("__part").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    own = rows.withColumn("__place", place).withColumn("__part", part).join(F.broadcast(maps), "__part", "left")
    byte = F.conv(F.hex(F.substring("__bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.bit_get(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1
    return own.select(*rows.columns, F.coalesce(bit, F.lit(False)).alias("__met"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, in runs of about `size` bytes of a text column; Spark bounds the batches' own bytes."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, end - at)
            at = end


def bytes_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text; a null counts as empty."""
    return (x or b"" for x in column.cast(pa.binary()).to_pylist())


#: Order key of a null doc_id, and doc_ids sampled for each part.
NO_ID, SAMPLED = -(1 << 63), 200


def order_key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def range_cuts(docs: DataFrame, parts: int) -> list[int]:
    """Up to parts - 1 order keys, ascending, maybe repeated, that part the rows of docs (doc_id) about evenly: quantiles of a sample, which sets the balance of tasks and no result."""
    key = docs.select(order_key().alias("k"))
    n = key.count()
    some = key if n <= SAMPLED * parts else key.sample(fraction=SAMPLED * parts / n, seed=7)
    k = np.sort(some.toArrow().column("k").to_numpy())  # about SAMPLED * parts numbers, whatever the table's size
    return k[len(k) * np.arange(1, parts) // parts].tolist() if len(k) else []


def range_bucket(cuts: list[int], k: Column, h: Column) -> Column:
    """The bucket of order key k, ascending with (k, h); h: 32 bits that part the rows of one key where it fills several buckets."""
    known = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    low = F.aggregate(known, F.lit(0), lambda a, x: a + (x < k).cast("int"))
    same = F.aggregate(known, F.lit(0), lambda a, x: a + (x == k).cast("int"))
    return (low + F.shiftright(h * (same + 1), 32)).cast("int")
