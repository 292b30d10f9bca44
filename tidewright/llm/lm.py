"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased tokens joined by single blanks, and one end (a line
feed). Each byte is eight binary decisions; a node of the tree is the last d
bytes (d from 0 to DEPTH) and the decisions of the current byte so far. With a
zeros and b ones seen at a node in training, its Krichevsky-Trofimov estimate
gives log P_kt(a, b), and bottom up

    P_w = P_kt                                 at depth DEPTH
    P_w = 1/2 P_kt + 1/2 prod P_w(children)    above.

The share of the first term is the node's weight; down the path of a context
the weights mix the estimates (b + 1/2) / (a + b + 1) of all depths. A path
ends at the deepest node that training has seen.

Counting, weighting and mixing are Spark aggregations and joins over the
contexts of all training texts, level by level. Nodes that only the texts to
score meet are in the tree with no counts and take their parent's prediction,
so the deepest level answers for every gram to score. Scoring is exact and
sends no model to the tasks: texts are dealt to blocks of BLOCK bytes, the
distinct grams of each block meet the deepest nodes by buckets of contexts, and
their logs come back to the block, where they are summed for each text. The
number of buckets grows with the texts.

The base score is a unigram model over tokens. Counts of tokens are joined;
only those of the most frequent ones, at most FREQUENT, are sent to the tasks.
Tokens are told apart by 64-bit hashes.

Defined cases: a null or empty text is the end alone; without training texts
every decision has probability 1/2 and the base score is 0; repeated rows are
scored each; a row without doc_id is a training row.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bytes_of, slices, staged, table
from .words import Words, parting

DEPTH, MEMO_BITS, FREQUENT = 5, 21, 200_000
CHUNK, BLOCK, HELD = 1_000_000, 16_000_000, 1_500_000
END = b"\n"
MIX, SPREAD, FORTY = 0x9E3779B97F4A7C15, 0x5BD1E9, (1 << 40) - 1


END_TOKEN = 0


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()  # bytes part at 20 and 09-0D alone


def token_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each token, the end of each text included; and how many each text has."""
    ends = w.first[1:]
    return np.insert(w.hashes(), ends, END_TOKEN).view(np.int64), np.diff(w.first) + 1


def grams(w: Words, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each byte to score: its context (latest byte lowest) above the byte itself; and where each text begins."""
    raw = np.frombuffer(w.joined, np.uint8)
    keep = raw != 32
    keep[1:] |= keep[:-1].copy()  # and one blank after each word
    words = np.concatenate(([0], np.cumsum(w.length + 1)))[w.first]
    size = np.diff(words)
    b = np.concatenate((np.zeros(7, np.uint8), raw[keep]))
    b[words[1:][size > 0] + 6] = END[0]
    if (size == 0).any():  # texts without words: the end alone
        b = np.insert(b, words[:-1][size == 0] + 7, END[0])
        size = np.maximum(size, 1)
    first = np.cumsum(size) - size
    g = np.ndarray((len(b) - 7,), ">u8", np.ascontiguousarray(b), 0, (1,)).astype(np.uint64)
    if depth < 7:
        g &= np.uint64((1 << 8 * (depth + 1)) - 1)
    for k in range(depth):  # before a text there are ends
        at = first[size > k] + k
        low = (1 << 8 * (k + 1)) - 1
        g[at] = g[at] & np.uint64(low) | np.uint64(int.from_bytes(END * 8, "big") & ((1 << 8 * (depth + 1)) - 1) & ~low)
    return g.view(np.int64), first


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and how often each occurs, by one sort."""
    k = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, int)
    return k[first], np.diff(np.concatenate((first, [len(k)])))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, int)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def counted(docs: DataFrame, depth: int, buckets: int) -> DataFrame:
    """How often each gram and each token occurs in docs (text), summed by task: tokens as rows (key, n), grams packed by bucket (bucket, n, grams, counts). Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {True: ([], []), False: ([], [])}

        def add(gram: bool, keys: np.ndarray) -> None:
            k, n = distinct(keys)
            own = held[gram]
            own[0].append(k)
            own[1].append(n)
            if sum(map(len, own[0])) > HELD:
                k, n = _merged(*own)
                own[0][:], own[1][:] = [k], [n]

        def rows(gram: bool) -> Iterator[pa.RecordBatch]:
            if held[gram][0]:
                k, n = _merged(*held[gram])
                if gram:
                    order, first = dealt(k, buckets)
                    some = [x for x in range(buckets) if first[x] < first[x + 1]]
                    parts = [order[first[x] : first[x + 1]] for x in some]
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "key": pa.nulls(len(some), pa.int64()), "n": pa.array(list(map(len, parts)), pa.int64()), "grams": pa.array([packed(k[p]) for p in parts], pa.binary()), "counts": pa.array([packed(n[p]) for p in parts], pa.binary())})
                else:
                    for at in range(0, len(k), 100_000):
                        part = k[at : at + 100_000]
                        yield pa.RecordBatch.from_pydict({"bucket": pa.nulls(len(part), pa.int32()), "key": part, "n": n[at : at + 100_000], "grams": pa.nulls(len(part), pa.binary()), "counts": pa.nulls(len(part), pa.binary())})
                held[gram][0].clear()
                held[gram][1].clear()

        for b in slices(batches, size=CHUNK):
            w = Words(list(bytes_of(b.column("text"))), parting())
            add(True, grams(w, depth)[0])
            add(False, token_hashes(w)[0])
            for gram in held:
                if held[gram][0] and len(held[gram][0][0]) > 2 * HELD:  # a very large partition
                    yield from rows(gram)
        for gram in held:
            yield from rows(gram)

    return staged(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, key long, n long, grams binary, counts binary"), "counts")


def with_log_kt(rows: DataFrame, out: str) -> DataFrame:
    """rows (a, b) with log P_kt of a zeros and b ones, by Stirling's series after eight steps of the recurrence. Columns are bound one by one, so none is worked out twice."""
    x = {"xa": F.col("a") + 0.5, "xb": F.col("b") + 0.5, "xc": F.col("a") + F.col("b") + 1.0}

    def product(c: str) -> Column:
        p = F.col(c)
        for i in range(1, 8):
            p = p * (F.col(c) + i)
        return p

    def stirling(c: str) -> Column:
        y, q = F.col(f"y{c}"), F.col(f"q{c}")
        return (y - 0.5) * F.log(y) - y + (F.lit(1 / 12) - q * (1 / 360) + q * q * (1 / 1260)) / y

    rows = rows.withColumns(x).withColumns({f"y{c}": F.col(c) + 8 for c in x})
    rows = rows.withColumns({f"q{c}": 1 / (F.col(f"y{c}") * F.col(f"y{c}")) for c in x} | {f"p{c}": product(c) for c in x})
    value = stirling("xa") + stirling("xb") - stirling("xc") - F.log(F.col("pxa") * F.col("pxb") / F.col("pxc")) + (0.5 * math.log(2 * math.pi) - math.log(math.pi))
    return rows.withColumn(out, F.when(F.col("a") + F.col("b") == 0, 0.0).otherwise(value)).drop(*(f"{k}{c}" for c in x for k in ("", "y", "q", "p")))


def tree(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(ctx, node, p) of the deepest level: the probability of a one where training has seen the node, else that of its deepest ancestor seen. From (key, n) of grams, n 0 for grams that are only to be scored."""
    byte = F.col("key").bitwiseAND(255)
    j = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")
    bits = counts.select(F.shiftright("key", 8).alias("ctx"), byte.alias("byte"), "n", j)
    node = F.expr("shiftleft(1L, j) + shiftright(byte, 8 - j)")
    bit = F.expr("shiftright(byte, 7 - j) & 1")
    level = bits.select("ctx", node.cast("int").alias("node"), (F.col("n") * (1 - bit)).alias("zero"), (F.col("n") * bit).alias("one"))
    level = level.groupBy("ctx", "node").agg(F.sum("zero").alias("a"), F.sum("one").alias("b"))
    # The deepest level, by far the largest, is written as counts alone: the rest follows from them.
    levels = [with_log_kt(staged(level, f"tree-{depth}"), "log_w").withColumn("weight", F.lit(1.0))]
    for d in range(depth - 1, -1, -1):
        up = levels[0].select(F.col("ctx").bitwiseAND((1 << 8 * d) - 1).alias("ctx"), "node", "a", "b", "log_w")
        up = up.groupBy("ctx", "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("log_w").alias("below"))
        up = with_log_kt(up, "kt").select("ctx", "node", "a", "b", F.col("kt").alias("own"), "below")  # both halved
        up = up.withColumn("top", F.greatest("own", "below")).withColumn("sum", F.col("top") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))))
        levels.insert(0, staged(up.select("ctx", "node", "a", "b", (F.col("sum") + math.log(0.5)).alias("log_w"), F.exp(F.col("own") - F.col("sum")).alias("weight")), f"tree-{d}"))
    kt = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    above = None
    for d, level in enumerate(levels):
        rows = level.select("ctx", "node", "a", "b", "weight", kt.alias("kt"))
        if above is None:
            rows = rows.select("*", F.lit(0.0).alias("done"), F.lit(1.0).alias("rest"), F.lit(0.5).alias("outer"))
        else:
            rows = rows.withColumn("parent", F.col("ctx").bitwiseAND((1 << 8 * (d - 1)) - 1)).join(above, ["parent", "node"])
        rows = rows.withColumn("p", F.when(F.col("a") + F.col("b") == 0, F.col("outer")).otherwise(F.col("done") + F.col("rest") * F.col("kt")))
        if d < depth:  # the last level is read once, and not by another
            rows = staged(rows.select(F.col("ctx").alias("parent"), "node", F.col("p").alias("outer"), (F.col("done") + F.col("rest") * F.col("weight") * F.col("kt")).alias("done"), (F.col("rest") * (1 - F.col("weight"))).alias("rest")), f"mixed-{d}")
            above = rows
    return rows.select("ctx", "node", "p")


def bucket_of(ctx: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a context; in Spark as bucket_column()."""
    h = ((ctx ^ ctx >> 17) & FORTY) * SPREAD  # 40 bits by 23
    return (h ^ h >> 29) % buckets


def bucket_column(ctx: Column, buckets: int) -> Column:
    h = ctx.bitwiseXOR(F.shiftright(ctx, 17)).bitwiseAND(F.lit(FORTY)) * F.lit(SPREAD).cast("long")
    return (h.bitwiseXOR(F.shiftright(h, 29)) % buckets).cast("int")


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys, as differences by byte planes."""
    planes = np.ascontiguousarray(np.diff(keys, prepend=0).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel())


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ascending grams by bucket, and where each bucket begins in it."""
    bucket = bucket_of(keys >> 8, buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def blocks(docs: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Rows of two sorts: runs of texts with their block (bucket null; packed: the texts, n bytes, as one compressed string); and of each block and bucket the n distinct grams (packed)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, row long, doc_ids array<{kind}>, sizes array<bigint>, bucket int, n long, packed binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        row, block, size, held = part << 40, part << 20, 0, []

        def placed(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
            raw, sizes = b"".join(texts), pa.array([len(t) for t in texts], pa.int64())
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_pydict({"block": [block], "row": [row], "doc_ids": one(ids), "sizes": one(sizes), "bucket": pa.nulls(1, pa.int32()), "n": pa.array([len(raw)], pa.int64()), "packed": pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())})

        def wanted(ids: pa.Array) -> pa.RecordBatch:
            keys = distinct(np.concatenate(held))[0]
            order, first = dealt(keys, buckets)
            some = [k for k in range(buckets) if first[k] < first[k + 1]]
            parts = [keys[order[first[k] : first[k + 1]]] for k in some]
            n = len(some)
            return pa.RecordBatch.from_pydict({
                "block": pa.array(np.full(n, block)), "row": pa.nulls(n, pa.int64()), "doc_ids": pa.nulls(n, pa.list_(ids.type)), "sizes": pa.nulls(n, pa.list_(pa.int64())),
                "bucket": pa.array(some, pa.int32()), "n": pa.array(list(map(len, parts)), pa.int64()), "packed": pa.array(list(map(packed, parts)), pa.binary()),
            })

        ids = None
        for b in slices(batches, size=min(CHUNK, BLOCK)):
            ids, texts = b.column("doc_id"), list(bytes_of(b.column("text")))
            yield placed(ids, texts)
            held.append(distinct(grams(Words(texts, parting()), depth)[0])[0])
            row, size = row + len(texts), size + sum(map(len, texts))
            if size >= BLOCK:
                yield wanted(ids)
                size, block, held = 0, block + 1, []
        if held:
            yield wanted(ids)

    return staged(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema), "blocks")


def looked_up(level: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, logs): the log probability of each gram of wanted (block, bucket, n, grams), in its order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            key, bucket, logit = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((key, bucket))
            key, bucket, logit = key[order], bucket[order], logit[order]
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            return pa.RecordBatch.from_pydict({
                "bucket": pa.array(bucket[cut[:-1]], pa.int32()), "n": pa.array(np.diff(cut), pa.int32()),
                "nodes": pa.array([packed(key[i:j]) for i, j in spans], pa.binary()), "logits": pa.array([logit[i:j].tobytes() for i, j in spans], pa.binary()),
            })

        for b in batches:
            held.append((b.column("key").to_numpy(), b.column("bucket").to_numpy(), b.column("logit").to_numpy()))
            size += b.num_rows
            if size >= HELD:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def answer(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        sizes = asked.column("n").to_pylist()
        if sizes:
            parts = [(unpacked(k, n), np.frombuffer(x, np.float32)) for k, n, x in zip(nodes.column("nodes").to_pylist(), nodes.column("n").to_pylist(), nodes.column("logits").to_pylist(), strict=True)]
            keys, logit = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys)
            keys, logit = keys[order], logit[order].astype(np.float64)
            all_asked = np.concatenate([unpacked(k, n) for k, n in zip(asked.column("grams").to_pylist(), sizes, strict=True)])
            g = distinct(all_asked)[0]
            back = np.searchsorted(g, all_asked)
            logs, byte = np.zeros(len(g)), g & 255
            for j in range(8):
                at = np.searchsorted(keys, (g & ~255) | 1 << j | byte >> 8 - j)  # each is there
                logs -= np.logaddexp(0, np.where(byte >> 7 - j & 1 == 1, -logit[at], logit[at]))
            logs = (logs / math.log(10)).astype(np.float32)[back]
        ends = np.cumsum([0, *sizes])
        return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "logs": pa.array([logs[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})

    key = F.shiftleft("ctx", 8).bitwiseOR(F.col("node").cast("long")).alias("key")
    logit = (F.log("p") - F.log1p(-F.col("p"))).cast("float").alias("logit")
    packs = level.select(key, bucket_column(F.col("ctx"), buckets).alias("bucket"), logit).mapInArrow(pack, "bucket int, n int, nodes binary, logits binary")
    return packs.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(answer, "block long, bucket int, logs binary")


class Memory:
    """Log probabilities of grams met before, in 2**bits slots; others are found among a block's."""

    def __init__(self, bits: int):
        self.bits = bits
        self.known, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)

    def logs(self, g: np.ndarray, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
        at = (g.view(np.uint64) * np.uint64(MIX) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.value[at].astype(np.float64)
        missed = np.flatnonzero(self.known[at] != g)
        if len(missed):
            out[missed] = logs[np.searchsorted(keys, g[missed])]
            self.known[at[missed]] = g[missed]
            self.value[at[missed]] = out[missed]
        return out


_memories: dict[str, Memory] = {}


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))


def scores(docs: DataFrame, training: DataFrame, depth: int = DEPTH, bits: int = MEMO_BITS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of each row of docs (doc_id, text), learning from training (text); workers remember 2**bits grams."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(16, size // BLOCK) | 1
    counts = counted(training, depth, buckets)
    dealt_out = blocks(docs, depth, buckets)
    wanted = dealt_out.where("bucket is not null").select("block", "bucket", "n", F.col("packed").alias("grams"))

    def merged(packs: pa.Table) -> pa.Table:
        """A bucket's distinct grams, of training and of texts to score, with their counts in training."""
        keys, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, m, c in zip(packs.column("grams").to_pylist(), packs.column("n").to_pylist(), packs.column("counts").to_pylist(), strict=True):
            keys.append(unpacked(k, m))
            n.append(np.zeros(m, np.int64) if c is None else unpacked(c, m))
        k, c = _merged(keys, n)
        return pa.table({"key": k, "n": c})

    packs = counts.where("bucket is not null").select("bucket", "n", "grams", "counts").unionByName(wanted.select("bucket", "n", "grams", F.lit(None).cast("binary").alias("counts")))
    both = packs.groupBy("bucket").applyInArrow(merged, "key long, n long")
    found = looked_up(tree(both, depth), wanted, buckets)
    words = staged(counts.where("bucket is null").groupBy("key").agg(F.sum("n").alias("n")), "words")
    total, distinct_tokens = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The tokens of the highest powers of two, as many as FREQUENT allows, go to all tasks.
    room, least = FREQUENT, 62
    for r in sorted(words.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["power"]):
        if r["n"] > room:
            break
        room, least = room - r["n"], r["power"]
    often = words.where(F.col("n") >= F.lit(1 << least)).toArrow()
    keys, n = often.column("key").to_numpy(), often.column("n").to_numpy()
    order = np.argsort(keys)
    shared, name = spark.sparkContext.broadcast((keys[order], n[order])), uuid.uuid4().hex
    base = math.log10(total + 0.5 * (distinct_tokens + 1))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(texts: pa.Table, logs: pa.Table) -> pa.Table:
        keys, n = shared.value
        if name not in _memories:
            _memories.clear()
            _memories[name] = Memory(bits)
        memory, parts = _memories[name], []

        def judged(ids: pa.Array, row: int, w: Words) -> pa.Table:
            g, first = grams(w, depth)
            ends = np.concatenate((first[1:], [len(g)]))
            score = np.add.reduceat(memory.logs(g, own, own_logs), first)
            h, sizes = token_hashes(w)
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            met = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            log = np.where(met, np.log10((n[at] if len(keys) else 0) + 0.5) - base, 0.0)
            begin = np.cumsum(sizes) - sizes
            left = h[~met]
            cut = np.concatenate(([0], np.cumsum(np.add.reduceat((~met).astype(np.int64), begin)))).astype(np.int32)
            return pa.table({"doc_id": ids, "row": np.arange(row, row + len(ids)), "n_tokens": sizes, "known": np.add.reduceat(met.astype(np.int64), begin), "base": np.add.reduceat(log, begin), "score": score, "n_bytes": ends - first, "left": pa.ListArray.from_arrays(pa.array(cut), pa.array(left))})

        def runs() -> Iterator[tuple[pa.Array, int, Words]]:
            for i in range(texts.num_rows):
                raw, ends = pa.decompress(texts.column("packed")[i].as_py(), texts.column("n")[i].as_py(), codec="zstd", asbytes=True), np.cumsum(texts.column("sizes")[i].values.to_numpy()).tolist()
                yield texts.column("doc_ids")[i].values, texts.column("row")[i].as_py(), Words([raw[x:y] for x, y in zip([0, *ends], ends, strict=False)], parting())

        # The block's grams in the order in which they were asked for.
        own = distinct(np.concatenate([distinct(grams(w, depth)[0])[0] for _, _, w in runs()]))[0]
        order, _ = dealt(own, buckets)
        own_logs = np.empty(len(own), np.float32)
        given = sorted(zip(logs.column("bucket").to_pylist(), logs.column("logs").to_pylist(), strict=True))
        own_logs[order] = np.frombuffer(b"".join(x for _, x in given), np.float32)
        for ids, row, w in runs():
            parts.append(judged(ids, row, w))
        return pa.concat_tables(parts)

    texts = dealt_out.where("bucket is null").select("block", "row", "doc_ids", "sizes", "n", "packed")
    rows = texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, f"doc_id {kind}, row long, n_tokens long, known long, base double, score double, n_bytes long, left array<long>")
    rows = staged(rows, "scored")
    rare = rows.select("row", F.explode("left").alias("key")).groupBy("row", "key").agg(F.count("*").alias("k"))
    rare = rare.join(words, "key", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("known_rare"),
        F.sum(F.col("k") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - base)).alias("base_rare"),
    )
    rows = rows.drop("left").join(rare, "row", "left")
    return rows.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"), "score", "n_bytes", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by the context tree and by the unigram base."""
    docs = table(spark, sf_dir, "documents")
    rows = scores(docs, docs.where(~held_out()))
    return rows.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
