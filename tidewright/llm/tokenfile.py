"""Token ids in binary shards of patched frame-of-reference blocks.

Format of a shard (all numbers little-endian)::

    "PFR2", n_ids u32, n_blocks u32
    starts   u32 x (n_blocks + 1)   where each block begins, from the first block
    blocks:  minimum u32, width u8, ids u8 (less one), exceptions u16
             128 differences to the minimum, `width` bits each, in 64-bit words from the lowest bit up
             exceptions x u8        places of outliers in the block
             exceptions x u32       their differences

The width is the least that holds the share PERCENTILE of a block's
differences; those that need more bits are the exceptions, packed as 0. With
the starts, any range of ids is read by decoding its blocks alone.

A file is a Parquet table of shards, written by Spark to the shared folder.
Texts are encoded where they are read; only ids (two bytes each where all fit)
are dealt to tasks, by ranges of doc_id, and sorted. Each shard holds whole
documents with their ids and lengths, and `first` counts the part's ids before
it. Bounds of the ranges come from a sample of doc_ids, as Spark's own range
partitioning takes it; they decide which task writes a row and nothing else. A
doc_id that fills several ranges is parted among them by its rows' content.

Defined cases: a null or empty text is the end id alone; rows of one doc_id go
by a hash of their ids, then the ids; null doc_ids come first; a very long text
is one document in one shard (its ids must fit 2 GB); an empty table gives no
shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, order_key, range_bucket, range_cuts, slices, staged, table
from .tokens import encoder, tokenizer_path

BLOCK, PERCENTILE, SHARD_IDS, END_ID = 128, 0.9, 1 << 18, 2
SHARD_SCHEMA = "part int, shard int, first long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def lanes(width: int) -> Iterator[tuple[int, int, int]]:
    """For each of a block's values: its place, its word, and its first bit there."""
    for i in range(BLOCK):
        yield i, i * width >> 6, i * width & 63


def squeezed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values in rows of bytes."""
    v = np.ascontiguousarray(values.T).astype(np.uint64)
    out = np.zeros((2 * width, len(values)), np.uint64)
    for i, word, bit in lanes(width):
        out[word] |= v[i] << np.uint64(bit)
        if bit + width > 64:
            out[word + 1] |= v[i] >> np.uint64(64 - bit)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8)


def spread(raw: np.ndarray, width: int) -> np.ndarray:
    """squeezed() back."""
    words = np.ascontiguousarray(np.ascontiguousarray(raw).view("<u8").T)
    out, mask = np.empty((BLOCK, len(raw)), np.uint32), np.uint64((1 << width) - 1)
    for i, word, bit in lanes(width):
        x = words[word] >> np.uint64(bit)
        if bit + width > 64:
            x |= words[word + 1] << np.uint64(64 - bit)
        out[i] = x & mask
    return out.T


def pack(ids: np.ndarray) -> bytes:
    """A shard of the ids (unsigned 32-bit)."""
    n, nb = len(ids), -(-len(ids) // BLOCK)
    x = np.full(nb * BLOCK, ids[-1] if n else 0, np.uint32)
    x[:n] = ids
    x = x.reshape(nb, BLOCK)
    low = x.min(1) if nb else np.zeros(0, np.uint32)
    rest = x - low[:, None]
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = np.ceil(np.log2(np.partition(rest, at, axis=1)[:, at].astype(np.float64) + 1)).astype(np.int64) if nb else np.zeros(0, np.int64)
    out_of = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    k = out_of.sum(1)
    starts = np.concatenate(([0], np.cumsum(8 + BLOCK // 8 * width + 5 * k)))
    head = b"PFR2" + np.array([n, nb], "<u4").tobytes() + starts.astype("<u4").tobytes()
    out = np.zeros(starts[-1], np.uint8)
    fields = np.zeros((nb, 8), np.uint8)
    fields[:, :4] = low.astype("<u4").view(np.uint8).reshape(nb, 4)
    fields[:, 4] = width
    fields[:, 5] = BLOCK - 1
    if n % BLOCK:
        fields[-1, 5] = n % BLOCK - 1
    fields[:, 6:] = k.astype("<u2").view(np.uint8).reshape(nb, 2)
    out[starts[:-1, None] + np.arange(8)] = fields
    packed = np.where(out_of, 0, rest)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        out[starts[rows][:, None] + 8 + np.arange(BLOCK // 8 * w)] = squeezed(packed[rows], int(w))
    block, place = np.nonzero(out_of)
    nth = np.arange(len(block)) - np.concatenate(([0], np.cumsum(k)))[block]
    begin = starts[block] + 8 + BLOCK // 8 * width[block]
    out[begin + nth] = place
    out[(begin + k[block] + 4 * nth)[:, None] + np.arange(4)] = rest[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return head + out.tobytes()


def unpack(payload: bytes, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """The ids from lo to hi (exclusive; None: all that follow), from their blocks alone."""
    if payload[:4] != b"PFR2":
        raise ValueError("not a shard of token ids")
    n, nb = np.frombuffer(payload, "<u4", 2, 4)
    hi = int(n) if hi is None else min(hi, int(n))
    if lo >= hi:
        return np.zeros(0, np.uint32)
    first, last = lo // BLOCK, -(-hi // BLOCK)
    starts = np.frombuffer(payload, "<u4", int(nb) + 1, 12).astype(np.int64)[first : last + 1] + 12 + 4 * (int(nb) + 1)
    raw = np.frombuffer(payload, np.uint8)
    fields = raw[starts[:-1, None] + np.arange(8)]
    low = np.ascontiguousarray(fields[:, :4]).view("<u4").ravel()
    width, k = fields[:, 4].astype(np.int64), np.ascontiguousarray(fields[:, 6:]).view("<u2").ravel().astype(np.int64)
    rest = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        rest[rows] = spread(raw[starts[rows][:, None] + 8 + np.arange(BLOCK // 8 * w)], int(w))
    block = np.repeat(np.arange(len(k)), k)
    nth = np.arange(len(block)) - np.concatenate(([0], np.cumsum(k)))[block]
    begin = starts[block] + 8 + BLOCK // 8 * width[block]
    rest[block, raw[begin + nth]] = np.ascontiguousarray(raw[(begin + k[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
    return (rest + low[:, None]).ravel()[lo - first * BLOCK : hi - first * BLOCK]


def encoded(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n, ids) of each row of docs (doc_id, text): ids as unsigned 16-bit numbers where all of a text's slice fit, else 32-bit. No shuffle."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches):
            ids, n = enc.encode(list(bytes_of(b.column("text"))), end_id)
            ids = ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4")
            at = np.concatenate(([0], np.cumsum(n))) * ids.itemsize
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n": n, "ids": pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids)])})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, ids binary")


def wide(column: pa.BinaryArray, n: np.ndarray) -> np.ndarray:
    """The ids of some rows of encoded(), one after the other, as unsigned 32-bit numbers."""
    at = np.frombuffer(column.buffers()[1], np.int32, len(n) + 1, 4 * column.offset).astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    width = np.diff(at) // n
    if (width == 2).all():
        return raw.view("<u2").astype(np.uint32)
    at -= at[0]
    return np.concatenate([raw[i:j].view(f"<u{k}").astype(np.uint32) for i, j, k in zip(at[:-1], at[1:], width, strict=True)])


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes (doc_id, text) and writes the shards, in ascending doc_id; returns the table read back."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = range_cuts(docs, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, first, held = None, 0, 0, []

        def row(part: int, shard: int, first: int, ids: np.ndarray, doc_ids: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), x)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "first": [first], "n_ids": [len(ids)], "doc_ids": whole(doc_ids), "lengths": whole(pa.array(n)), "payload": pa.array([pack(ids)], pa.binary())})

        def full(last: bool) -> Iterator[pa.RecordBatch]:
            """Shards of what is held; a rest that fills none stays, unless it is the part's last."""
            nonlocal shard, first, held
            ids, doc_ids, n = (np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            ends, at, done = np.cumsum(n), 0, 0
            while at < len(n):
                end = int(np.searchsorted(ends, done + SHARD_IDS)) + 1
                if end > len(n) and not last:
                    break
                end = min(end, len(n))
                yield row(now, shard, first, ids[done : ends[end - 1]], doc_ids.slice(at, end - at), n[at:end])
                shard, first, at, done = shard + 1, first + int(ends[end - 1]) - done, end, int(ends[end - 1])
            held = [(ids[done:], doc_ids.slice(at), n[at:])] if at < len(n) else []

        for b in batches:
            bucket = b.column("bucket").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else [0]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if bucket[i] != now:
                    if held:
                        yield from full(True)
                    now, shard, first = int(bucket[i]), 0, 0
                part = b.slice(i, j - i)
                n = part.column("n").to_numpy()
                held.append((wide(part.column("ids"), n), part.column("doc_id"), n))
                if sum(len(h[0]) for h in held) >= 4 * SHARD_IDS:
                    yield from full(False)
        if held:
            yield from full(True)

    rows = encoded(docs, path, end_id).withColumns({"k": order_key(), "h": F.crc32("ids")})
    rows = rows.withColumn("bucket", range_bucket(cuts, F.col("k"), F.col("h"))).repartitionById(parts, "bucket").sortWithinPartitions("bucket", "k", "h", "ids")
    return staged(rows.select("bucket", "doc_id", "n", "ids").mapInArrow(run, SHARD_SCHEMA), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; start counts the ids of all documents before it.

    Only a total for each part goes through the driver, as many as there were
    write tasks.
    """
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base = dict(zip([p for p, _ in totals], np.cumsum([0, *(n for _, n in totals)])[:-1].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                part, first, payload = (b.column(c)[r].as_py() for c in ("part", "first", "payload"))
                n = b.column("lengths")[r].values.to_numpy()
                ids, ends = unpack(payload).astype("<u4", copy=False), np.cumsum(n)
                at = np.concatenate(([0], 4 * ends)).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_ids")[r].values, "start": ends - n + base[part] + first, "n_tokens": n, "ids": column})

    return shards.select("part", "first", "doc_ids", "lengths", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to token shards and read back: place, length and checksum of its ids."""
    back = read_documents(write_shards(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
