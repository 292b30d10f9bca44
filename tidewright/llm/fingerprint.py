"""Document fingerprints: quartile bucket digests.

Every byte triplet of a text is hashed into one of ``BUCKETS`` counters. The
digest keeps, for each bucket, the quartile (0 to 3) its count falls into, and
one byte for the logarithm of the text's length; counts themselves are
forgotten, so texts of one kind but of unlike length stay comparable.

Two digests differ by the mean distance of their quartiles. Two unrelated
digests with the same shares of each quartile would differ by a known mean;
likeness is 1 less the one over the other, less a bounded penalty for unlike
lengths, held to 0..1. So buckets that both texts leave empty count for
nothing, and unrelated short texts are near 0 like unrelated longer ones. Long
texts of one language share much of their triplets' distribution and are never
that far apart; edited copies stay above them.

Defined cases: a null text counts as empty; an empty text and a text of one or
two bytes have no triplet (all quartiles 0); equal texts have equal digests;
repeated rows are digested row by row; a very long text is counted in parts of
CHUNK bytes; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, order_key, range_bucket, range_cuts, slices, table

BUCKETS = 1024
#: Steps of the length byte for each doubling, what a step takes off the likeness, and the most that lengths can take.
LENGTH_STEPS, STEP_COST, LENGTH_COST = 8, 0.016, 0.4
CHUNK = 1 << 20


def codes(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Length byte, then a quartile for each bucket."""
    counts = np.zeros(buckets, np.int64)
    for at in range(0, max(len(text) - 2, 0), CHUNK):
        b = np.frombuffer(text, np.uint8, min(CHUNK + 2, len(text) - at), at).astype(np.uint32)
        h = (b[:-2] | b[1:-1] << 8 | b[2:] << 16) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        h ^= h >> np.uint32(13)
        counts += np.bincount(h % np.uint32(buckets), minlength=buckets)
    cuts = np.partition(counts, (buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1))[[buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1]]
    quartile = (counts > cuts[0]).view(np.uint8) + (counts > cuts[1]).view(np.uint8) + (counts > cuts[2]).view(np.uint8)
    return np.concatenate(([min(255, round(LENGTH_STEPS * np.log2(len(text) + 1)))], quartile)).astype(np.uint8)


def encode(c: np.ndarray) -> str:
    q = c[1:].reshape(-1, 4)
    return (bytes(c[:1]) + (q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]).astype(np.uint8).tobytes()).hex()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.concatenate((raw[:1], np.stack([raw[1:] >> s & 3 for s in (6, 4, 2, 0)], 1).ravel()))


_DISTANCE = np.abs(np.subtract.outer(np.arange(4), np.arange(4)))


def code_likeness(a: np.ndarray, b: np.ndarray) -> float:
    met = np.bincount(4 * a[1:] + b[1:], minlength=16).reshape(4, 4).astype(np.float64)
    if (far := float((met * _DISTANCE).sum())) == 0:  # the same quartile everywhere
        quartiles = 1.0
    else:
        quartiles = 1.0 - far * met.sum() / float((np.outer(met.sum(1), met.sum(0)) * _DISTANCE).sum())
    return max(0.0, quartiles - min(LENGTH_COST, STEP_COST * abs(int(a[0]) - int(b[0]))))


def digest(text: str | None) -> str:
    return encode(codes((text or "").encode()))


def likeness(a: str, b: str) -> float:
    """0 to 1 for two digests; 1 for equal ones."""
    return code_likeness(decode(a), decode(b))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df and the digest of its text column; no shuffle. A column already named ``out`` is replaced."""
    names = [c for c in df.columns if c != out]
    schema = df.select(*names, F.lit("").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            fp = pa.array([encode(codes(t)) for t in bytes_of(b.column(names.index(text)))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, fp], names=[*names, out])

    return df.select(*names).mapInArrow(run, schema)


def with_next_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) and, as next_text, the text of the next row in descending doc_id; the last row's next is the first.

    Rows are windowed within ranges of doc_id, so no task gets them all, and a
    doc_id that fills several ranges is parted by its texts; the first row of
    each range serves the last of the range before. Ties of doc_id go by a hash
    of the text, then the text; null ids come last.
    """
    spark = docs.sparkSession
    cuts = range_cuts(docs, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), order_key().alias("k")).withColumn("h", F.crc32("text"))
    rows = rows.withColumn("bucket", range_bucket(cuts, F.col("k"), F.col("h")))
    # The head of each range: as many as there are cuts at most, and one more.
    top = rows.groupBy("bucket").agg(F.max("k").alias("k")).collect()
    used = sorted(r["bucket"] for r in top)
    heads = rows.join(F.broadcast(spark.createDataFrame(top, "bucket int, k long")), ["bucket", "k"]).groupBy("bucket").agg(F.max(F.struct("h", "text")).alias("head"))
    serves = dict(zip(used, [*used[1:], *used[:1]], strict=True))
    given = F.create_map(*(F.lit(x) for pair in serves.items() for x in pair))[F.col("bucket")] if serves else F.lit(None).cast("int")
    heads = heads.select(given.alias("bucket"), F.col("head.text").alias("head_text"))
    w = Window.partitionBy("bucket").orderBy(F.desc("k"), F.desc("h"), F.desc("text"))
    rows = rows.select("bucket", "doc_id", "text", F.lead("text").over(w).alias("nx"))
    return rows.join(heads.hint("merge"), "bucket").select("doc_id", "text", F.coalesce("nx", "head_text").alias("next_text"))


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's digest against those of its edited text and of the next document."""
    n, k = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    rows = (
        with_next_text(table(spark, sf_dir, "documents"))
        .select("doc_id", n.cast("long").alias("n_chars"), "text", F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k)).alias("edited"), "next_text")
        .select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", "edited", "next_text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (b"", codes(b""))  # rows come in order within a block, so a row's next text is mostly the next row's own
        for b in slices(batches):
            own, edited, near_edited, near_next = [], [], [], []
            for text, other, after in zip(*(bytes_of(b.column(c)) for c in ("text", "edited", "next_text")), strict=True):
                f = last[1] if text == last[0] else codes(text)
                g = codes(other)
                last = (after, f if after == text else codes(after))
                own.append(encode(f))
                edited.append(encode(g))
                near_edited.append(code_likeness(f, g))
                near_next.append(code_likeness(f, last[1]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_chars", "edited_sha256")), pa.array(own, pa.string()), pa.array(edited, pa.string()), pa.array(near_edited, pa.float64()), pa.array(near_next, pa.float64())], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
