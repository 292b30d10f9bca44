"""Best-fit packing of documents into fixed-length sequences.

Pieces are packed by their lengths alone. The histogram of lengths (at most
one count for each length up to the capacity) is all that the plan needs:

* Large pieces, above a third of the capacity, go at most two to a sequence.
  From the largest down, each takes the largest other large piece that fits.
* Smaller pieces, from the largest down, go each to the sequence with the
  least room that still holds them, or to a new one.

Equal lengths are planned together: a group of sequences filled alike is one
entry, so the plan's size depends on the capacity and not on the number of
documents (less than 2 * capacity groups, of at most sqrt(2 * capacity)
different lengths each). Tasks then number the pieces of each length and look
their places up in the plan.

Defined cases: a null or empty text is its end id alone; repeated rows are
packed each; a document longer than the capacity is cut into full pieces, the
last maybe shorter (its ids pass through one task); an empty table gives an
empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucketed, bytes_of, slices, table
from .tokens import encoder, tokenizer_path

CAPACITY, END_ID = 4096, 1
#: Bits for the number of a piece among those of its length; rows with ids that a task works on at once; bytes of text that it encodes at once.
RANK_BITS, UNPACKED, CHUNK = 48, 128, 500_000


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first piece of that length, first sequence, offset): pieces from there on go to sequences from there on. And the number of sequences."""
    left, runs, used = dict(counts), [], 0
    seen: Counter[int] = Counter()
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, how many)

    def place(length: int, base: int, n: int, offset: int) -> None:
        runs.append((length, seen[length], base, offset))
        seen[length] += n

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        a = large[-1]
        i = bisect.bisect_right(large, capacity - a) - 1
        if i >= 0 and large[i] == a and left[a] == 1:
            i -= 1
        b = large[i] if i >= 0 else 0
        n = left[a] // 2 if a == b else min(left[a], left[b]) if b else left[a]
        place(a, used, n, 0)
        left[a] -= n
        if b:
            place(b, used, n, a)
            left[b] -= n
        rooms[capacity - a - b].append((used, n))
        used += n
        for x in {a, b} - {0}:
            if not left[x]:
                del large[bisect.bisect_left(large, x)]

    sizes = sorted(rooms)
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[length]
        while n:
            i = bisect.bisect_left(sizes, length)
            if i == len(sizes):
                m = -(-n // (capacity // length))
                rooms[capacity].append((used, m))
                sizes.append(capacity)
                used += m
            room = sizes[i]
            base, m = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], sizes[i]
            each = room // length
            full = min(m, n // each)
            parts = [(base, full, each)] if full else []
            if full < m:
                rest = min(n - full * each, each)
                parts += [(base + full, 1, rest)] if rest else []
                if (kept := m - full - bool(rest)):
                    parts.append((base + m - kept, kept, 0))
            for first, bins, k in parts:
                for j in range(k):
                    place(length, first, bins, capacity - room + j * length)
                n -= bins * k
                r = room - k * length
                if r not in rooms:
                    bisect.insort(sizes, r)
                rooms[r].append((first, bins))
    return np.array(runs, np.int64).reshape(-1, 4), used


def pieces_of(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) and, for the packing, the task and the number of the piece among those of its length there; written to the shared folder in buckets by task."""
    path = path or tokenizer_path()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in slices(batches, size=CHUNK):
            ids, n = enc.encode(list(bytes_of(b.column("text"))), end_id)
            ids, pieces = ids.astype("<u4", copy=False), -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, n[row] - start)
            at = np.concatenate(([0], np.cumsum(length)))
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            new = np.concatenate(([True], np.diff(length[order]) > 0)) if len(order) else np.zeros(0, bool)
            nth = np.empty(len(order), np.int64)
            nth[order] = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            nth += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            out = {"doc_id": b.column("doc_id").take(pa.array(row)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array(np.full(len(row), part, np.int32)), "nth": nth}
            if keep_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_pydict(out)

    return bucketed(docs.select("doc_id", "text").mapInArrow(run, schema), "pieces", "part")


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset, without part and nth; ids, where there are any, as little-endian unsigned 32-bit numbers.

    The number of a piece among all of its length is its number within its task
    and how many the tasks before have. Pieces are bucketed by task, so they meet
    these numbers (at most one for each length, in one row for each task) where
    they are read: ids move in no shuffle.
    """
    sizes = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # One row for each task and length: a window over one length meets at most as many rows as there were tasks.
    before = sizes.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    pair = F.sort_array(F.collect_list(F.struct("length", "before")))
    before = before.groupBy("part").agg(pair.alias("x")).select("part", F.col("x.length").alias("lengths"), F.col("x.before").alias("befores"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row for each length at most
    runs, _ = plan(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    key = runs[:, 0] << RANK_BITS | runs[:, 1]
    shared = pieces.sparkSession.sparkContext.broadcast((key, runs[:, 1:]))
    names = [c for c in pieces.columns if c not in ("part", "nth")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runs = shared.value
        few = UNPACKED if "ids" in names else None
        for b in (whole.slice(at, few) for whole in batches for at in range(0, whole.num_rows, few or max(whole.num_rows, 1))):
            rank = b.column("rank").to_numpy()
            own = runs[np.searchsorted(key, b.column("length").to_numpy() << RANK_BITS | rank, "right") - 1]
            kept = {c: b.column(c) for c in names}
            if few:
                raw = memoryview(kept["ids"].flatten().to_numpy().astype("<u4")).cast("B")
                at = 4 * np.concatenate(([0], np.cumsum(kept["length"].to_numpy())))
                kept["ids"] = pa.array([bytes(raw[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept.values(), pa.array(own[:, 1] + rank - own[:, 0]), pa.array(np.ascontiguousarray(own[:, 2]))], names=[*names, "sequence_id", "offset"])

    rank = F.col("nth") + F.get("befores", F.array_position("lengths", F.col("length")).cast("int") - 1)
    ranked = pieces.join(before.hint("shuffle_hash"), "part").select(*names, rank.alias("rank"))
    kept = ranked.drop("rank").withColumn("ids", F.lit(b"")) if "ids" in names else ranked.drop("rank")
    return ranked.mapInArrow(run, kept.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema)


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, at most `capacity` ids each, little-endian unsigned 32-bit."""
    rows = packed(pieces_of(docs, path, capacity, keep_ids=True), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.reduce(parts, F.lit(b""), lambda ids, x: F.concat(ids, x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document and its place; keep_ids: with its ids, little-endian unsigned 32-bit, so the sequences can be read from the rows."""
    return packed(pieces_of(docs, keep_ids=keep_ids))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place."""
    return pack_documents(table(spark, sf_dir, "documents"))
