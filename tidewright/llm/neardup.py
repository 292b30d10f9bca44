"""Near duplicates by bottom-k sketches of one hash function.

A document is the set of its 5-word shingles, hashed to 64 bits by one mixed
hash; its sketch is the K least values. Documents with equal sets are one from
the start, a node named by their least doc_id and the set's digest. Then:

1. Inverted lists. Two sets with a Jaccard similarity of 0.75 share, of their
   sketches, OVERLAP values or more but for less than one pair in 10**9 (sets
   small enough for their sketch to be the whole set: all that similarity
   asks). So each node is listed under all but OVERLAP - 1 of its values, the
   most frequent ones left out; values no other node retains make no list.
   Passages common to many documents are thus no list of their own unless they
   make up a good part of a document.
2. Hubs. Each list goes to its hub, the member whose sketch values are the
   most frequent on average. Copies of one text have most lists in common, and
   these mostly one hub, so each member comes once to a hub and not once for
   every list. Any two members of one list meet at its hub.
3. Every member is first compared with its hub, in as many tasks as a hub's
   size asks for; those alike are joined by it. A pair of which one is left
   over is compared as well: members are dealt to blocks of bounded size, and
   each two blocks of which one is of those left are compared by one task.
   Pairs of members joined to the hub need no look: they are one class.

A pair is compared in three steps: the overlap of its sketches, the similarity
that its union sketch (the K least values of both) estimates, SLACK standard
errors below the threshold, and the full sets, exactly. A task returns links
that join what it found to be similar, at most one less than it has members,
never all pairs.

No list, hub or pair is cut; only pairs that a filter rules out go unread.

Defined cases: null, empty and blank texts have no set and no link; with fewer
than five words the whole sequence is the one shingle; repeated rows are equal
sets of one doc_id, rows of one doc_id with unlike texts are judged each by its
own set; rows without doc_id come after all others, and are a class of no
doc_id if they meet none that has one; a very long text's set is held whole by
one task at a time; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bytes_of, met_by, slices, staged, table
from .components import components
from .words import Words, mixed, parting

#: SLACK lets the union estimate of K values ask for no more than OVERLAP: a pair of the similarity itself fails either with a probability of 2.3e-10.
WORDS, K, OVERLAP, SLACK = 5, 48, 16, 6.7
#: Members and shingles of a block, as far as even dealing holds.
BLOCK, BLOCK_SHINGLES = 1000, 1_000_000
#: The similarity, as a fraction.
TOP, BOTTOM = 75, 100
#: Stands for no doc_id: after all others.
NO_ID = (1 << 63) - 1
MIX = np.uint64(0xBF58476D1CE4E5B9)


def sets_of(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    w = Words(texts, parting())
    h, first = w.hashes(), w.first
    rolled = np.full(max(len(h) - words + 1, 0), words, np.uint64)
    for i in range(words):
        rolled = (rolled ^ rolled >> np.uint64(29)) * MIX + h[i : len(h) - words + 1 + i]
    rolled = mixed(rolled)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= words:
            own = np.sort(rolled[i : j - words + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif j > i:
            whole = np.full(1, j - i, np.uint64)
            for x in range(i, j):
                whole = (whole ^ whole >> np.uint64(29)) * MIX + h[x]
            out.append(mixed(whole))
        else:
            out.append(h[:0])
    return out


def node(doc: str = "doc", digest: str = "a") -> Column:
    return F.struct(F.col(doc).alias("doc"), F.col(digest).alias("a"))


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, doc: doc_id or NO_ID, text_key, n_shingles, set_a, set_b: a 128-bit digest of the set, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = sets_of(list(bytes_of(b.column("text"))))
            d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s) for s in sets), np.int64).reshape(-1, 2)
            kept = [s[:k].view(np.int64) for s in sets]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in kept]))).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text_key": b.column("text_key"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "set_a": pa.array(d[:, 0]), "set_b": pa.array(d[:, 1]), "sketch": pa.ListArray.from_arrays(ends, np.concatenate([*kept, np.zeros(0, np.int64)]))})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key().alias("text_key")).mapInArrow(run, "doc_id long, text_key binary, n_shingles long, set_a long, set_b long, sketch array<long>")
    return rows.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def listed(reps: DataFrame, k: int = K) -> DataFrame:
    """(doc, value, common): the inverted lists of (doc, n, sketch); common: how frequent the document's sketch values are on average."""
    full = k * TOP // BOTTOM  # up to here a partner's sketch is whole, too
    values = reps.select("doc", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    met = values.join(often, "value")
    need = F.when(F.col("n") <= full, F.ceil(F.col("n") * TOP / BOTTOM)).otherwise(F.lit(OVERLAP))
    spare = (F.size("met") - need + 1).cast("int")
    each = met.groupBy("doc", "n", "kept").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("met"), (F.sum("df") / F.col("kept")).alias("common"))
    each = each.where(spare > 0).select("doc", "common", F.explode(F.slice("met", 1, F.greatest(spare, F.lit(1)))).alias("x"))
    return each.select("doc", "common", F.col("x.value").alias("value"))


def at_hubs(lists: DataFrame) -> DataFrame:
    """(hub, doc): the members of every list at the list's hub."""
    hub = lists.groupBy("value").agg(F.min(F.struct((-F.col("common")).alias("c"), F.col("doc"))).alias("x"), F.count("*").alias("n")).where("n > 1")
    return lists.join(hub.select("value", F.col("x.doc").alias("hub")), "value").select("hub", "doc").distinct()


def whole_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc: a node, n, set) of the nodes that nodes (doc, text_key) names, each by one of its texts; the set's hashes ascending, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = sets_of(list(bytes_of(b.column("text"))))
            yield pa.RecordBatch.from_pydict({"doc": b.column("doc"), "a": b.column("a"), "n": pa.array([len(s) for s in sets], pa.int64()), "set": pa.array([s.tobytes() for s in sets], pa.binary())})

    # The nodes grow with the documents: no broadcast, whatever their number. Few texts are of nodes, so the others are left out before the shuffle. Rows equal in both keys have one text, and are one before it.
    named = staged(nodes.select(F.col("doc.doc").alias("id"), F.col("doc.a").alias("a"), "text_key"), "named")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text"), text_key().alias("text_key"))
    texts = met_by(texts, named, ("id", "text_key")).where("__met").groupBy("id", "text_key").agg(F.first("text").alias("text"))
    texts = texts.join(named.hint("merge"), ["id", "text_key"])
    rows = texts.select(F.col("id").alias("doc"), "a", "text").mapInArrow(run, "doc long, a long, n long, set binary")
    return rows.select(node().alias("doc"), "n", "set")


def _union_estimates(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of sketches (padded with the highest value): the overlap, values of the union sketch that both have, and its size."""
    both = np.sort(np.concatenate((x, y), axis=1), axis=1)
    real = both < np.uint64(2**64 - 1)
    new = np.concatenate((np.ones((len(both), 1), bool), both[:, 1:] != both[:, :-1]), axis=1) & real
    nth = np.cumsum(new, axis=1)
    twice = np.concatenate((np.zeros((len(both), 1), bool), both[:, 1:] == both[:, :-1]), axis=1) & real
    return twice.sum(1), (twice & (nth <= k)).sum(1), np.minimum(nth[:, -1], k)


def _maybe(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, k: int) -> np.ndarray:
    """Whether pairs of sketches (rows of x and y) may be of sets that are similar."""
    overlap, common, m = _union_estimates(x, y, k)
    least = np.minimum(size_x, size_y)
    need = np.where(np.maximum(size_x, size_y) <= k, -(-least * TOP // BOTTOM), np.minimum(OVERLAP, -(-least * TOP // BOTTOM)))
    near = TOP / BOTTOM
    error = np.where(m < k, 1e-9, SLACK * np.sqrt(near * (1 - near) / m))  # a smaller union sketch is the union
    return (overlap >= need) & (common / m >= near - error)


def _sketch(sets: list[np.ndarray], k: int) -> np.ndarray:
    out = np.full((len(sets), k), 2**64 - 1, np.uint64)
    for row, s in zip(out, sets, strict=True):
        row[: min(k, len(s))] = s[:k]
    return out


def _fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sizes of two sets allow for the similarity."""
    return (a * BOTTOM >= b * TOP) & (b * BOTTOM >= a * TOP)


def alike(hub: np.ndarray, sets: list[np.ndarray], k: int = K) -> np.ndarray:
    """Which of some sets are similar to one."""
    size = np.array([len(s) for s in sets])
    out = _fit(size, np.int64(len(hub)))
    at = np.flatnonzero(out)
    if len(at):
        own = np.repeat(_sketch([hub], k), len(at), axis=0)
        at = at[_maybe(own, _sketch([sets[i] for i in at], k), np.full(len(at), len(hub)), size[at], k)]
    out[:] = False
    for i in at:
        both = len(np.intersect1d(hub, sets[i], assume_unique=True))
        out[i] = BOTTOM * both >= TOP * (len(hub) + size[i] - both)
    return out


def _products(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    size = np.array([len(s) for s in sets])
    value, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(number, minlength=len(value)) > 1
    number, owner = (np.cumsum(shared) - 1)[number[shared[number]]], owner[shared[number]]
    out = np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        lo, hi = np.searchsorted(number, (at, at + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[lo:hi], number[lo:hi] - at] = 1
        out += (part @ part.T).astype(np.int64)  # of 4096 values: exact
    return out


def linked(sets: list[np.ndarray], side: np.ndarray, k: int = K) -> list[tuple[int, int]]:
    """Links, by their places, that join the similar ones of some sets; side: 0 and 1 for two blocks of which only pairs across count, else all 0."""
    size = np.array([len(s) for s in sets])
    a, b = np.triu_indices(len(sets), 1)
    fit = _fit(size[a], size[b])
    if side.any():
        fit &= side[a] != side[b]
    a, b = a[fit], b[fit]
    if not len(a):
        return []
    sketch, keep = _sketch(sets, k), []
    for at in range(0, len(a), 20_000):
        x, y = a[at : at + 20_000], b[at : at + 20_000]
        keep.append(_maybe(sketch[x], sketch[y], size[x], size[y], k))
    keep = np.concatenate(keep)
    a, b = a[keep], b[keep]
    if len(a) > 50:
        used = np.unique(np.concatenate((a, b)))
        inter = _products([sets[i] for i in used])[np.searchsorted(used, a), np.searchsorted(used, b)].astype(np.int64)
    else:
        inter = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    ok = BOTTOM * inter >= TOP * (size[a] + size[b] - inter)
    root, out = list(range(len(sets))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def grouped(key: list[str], rows: DataFrame, judge) -> DataFrame:
    """rows (key, side, doc: a node, set) dealt and sorted by key and side; judge(sides, sets) of each group gives links by place, written as (u, v)."""
    rows = rows.select(*key, "side", F.col("doc.doc").alias("doc"), F.col("doc.a").alias("a"), "set").repartition(*key).sortWithinPartitions(*key, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done(final: bool) -> pa.RecordBatch:
            nonlocal held
            found, rest = judge(np.array([h[0] for h in held]), [np.frombuffer(h[3], np.uint64) for h in held], final)
            out = [(*held[i][1:3], *held[j][1:3]) for i, j in found]
            held = [held[i] for i in rest]
            return pa.RecordBatch.from_pydict({n: pa.array([x[c] for x in out], pa.int64()) for c, n in enumerate(("u", "ua", "v", "va"))})

        for b in batches:
            for at in range(0, b.num_rows, 500):
                c = [x.to_pylist() for x in b.slice(at, 500).columns]
                for r in zip(*c, strict=True):
                    if r[: len(key)] != now:
                        if len(held) > 1:
                            yield done(True)
                        now, held = r[: len(key)], []
                    held.append(r[len(key) :])
                if len(held) > 1:
                    yield done(False)
        if len(held) > 1:
            yield done(True)

    return rows.mapInArrow(run, "u long, ua long, v long, va long").select(node("u", "ua").alias("u"), node("v", "va").alias("v"))


def to_hub(sides: np.ndarray, sets: list[np.ndarray], final: bool) -> tuple[list[tuple[int, int]], list[int]]:
    """The first set is the hub's: links with it, and it alone is kept for what follows."""
    return [(0, i + 1) for i in np.flatnonzero(alike(sets[0], sets[1:]))], [0]


def in_blocks(sides: np.ndarray, sets: list[np.ndarray], final: bool) -> tuple[list[tuple[int, int]], list[int]]:
    """Links of a whole group."""
    return (linked(sets, sides), []) if final else ([], list(range(len(sets))))


def blocks_for(n: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")


def links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): links of the members (hub, doc) of each hub."""
    rows = staged(members.join(sets.select("doc", "n"), "doc"), "sized")
    deal = lambda blocks: F.pmod(F.xxhash64("doc"), blocks).cast("int")
    size = rows.groupBy("hub").agg(blocks_for(F.count("*"), F.sum("n")).alias("blocks"))
    own = rows.where("doc <> hub").join(size, "hub").select("hub", deal(F.col("blocks")).alias("block"), "doc", F.lit(1).alias("side"))
    heads = own.select("hub", "block").distinct().select("hub", "block", F.col("hub").alias("doc"), F.lit(0).alias("side"))
    first = staged(grouped(["hub", "block"], own.unionByName(heads).join(sets, "doc"), to_hub), "hub-links")  # u: the hub
    rows = rows.join(first.select(F.col("u").alias("hub"), F.col("v").alias("doc"), F.lit(1).alias("joined")), ["hub", "doc"], "left")
    rows = rows.select("hub", "doc", "n", (F.col("joined").isNotNull() | (F.col("doc") == F.col("hub"))).alias("joined"))
    some = lambda c: F.when(F.col("joined") == c, F.col("n"))
    size = rows.groupBy("hub").agg(blocks_for(F.count(some(False)), F.sum(some(False))).alias("left"), blocks_for(F.count(some(True)), F.sum(some(True))).alias("done")).where("left > 0")
    rows = rows.join(size, "hub")
    rows = rows.select("*", F.when(F.col("joined"), F.col("left") + deal(F.col("done"))).otherwise(deal(F.col("left"))).alias("own"))
    # Blocks of those left are numbered first: each meets all blocks, those of the joined meet these alone. Only the hub is known to be unlike those left.
    rows = rows.where("doc <> hub").select("hub", "doc", "own", F.explode(F.sequence(F.lit(0), F.when(F.col("joined"), F.col("left")).otherwise(F.col("left") + F.col("done")) - 1)).alias("other"))
    rows = rows.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "doc")
    return first.unionByName(grouped(["hub", "i", "j"], rows.join(sets, "doc"), in_blocks))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, text_key, n_shingles, own: the row's node or null, component: the least node that it reaches) of each row of docs (doc_id, text)."""
    sk = staged(sketches(docs), "sketches")
    key = F.struct("doc", "text_key")
    equal = sk.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min(key).alias("rep"), F.count("*").alias("rows"))
    equal = staged(equal.select("set_a", "set_b", F.struct(F.col("rep.doc").alias("doc"), F.col("set_a").alias("a")).alias("own"), F.col("rep.text_key").alias("text_key")), "equal-sets")
    reps = sk.join(equal.select(F.col("own.doc").alias("doc"), "set_a", "set_b", "text_key", "own"), ["doc", "set_a", "set_b", "text_key"])
    lists = staged(listed(reps.select(F.col("own").alias("doc"), F.col("n_shingles").alias("n"), "sketch").distinct()), "lists")
    members = staged(at_hubs(lists), "members")
    some = members.select("doc").distinct()
    sets = staged(whole_sets(docs, equal.select(F.col("own").alias("doc"), "text_key").join(some, "doc", "left_semi")), "sets")
    comp = components(links(members, sets))
    out = sk.join(equal.select("set_a", "set_b", "own"), ["set_a", "set_b"], "left").join(comp.withColumnRenamed("node", "own"), "own", "left")
    return out.select("doc_id", "doc", "text_key", "n_shingles", "own", F.coalesce("component", "own").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text); a row without doc_id is kept if its class has none."""
    least = F.when(F.col("component").isNull(), F.col("doc_id")).when(F.col("component.doc") < NO_ID, F.col("component.doc"))
    return classes(docs).select("doc_id", "n_shingles", least.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, of each class of near duplicates one row alone, all columns kept: of its rows with the least doc_id (null ids last) one with the least text hash. Rows without words are all kept."""
    rows = classes(docs).where("component is not null")
    # Few rows to a class: what its rows share is found by sums before the shuffle.
    best = rows.groupBy("component").agg(F.min(F.struct("doc", "text_key")).alias("best"))
    keys = rows.groupBy("doc", "text_key", "component").agg(F.count("*").alias("n"))
    decided = keys.join(best, "component").select("doc", "text_key", (F.struct("doc", "text_key") == F.col("best")).alias("stays"), "n").where("not stays or n > 1")
    key = ("doc", "text_key")
    decided = staged(decided.select(*key, "stays"), "decided")
    own = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_key().alias("text_key"))
    # Most rows are alone: only those that may be decided on move.
    own = met_by(own, decided, key)
    met = own.where("__met").join(decided, list(key), "left")
    alone = own.where("not __met").select("row.*").unionByName(met.where("stays is null").select("row.*"))
    # Equal rows, or rows of one doc_id and text that other columns tell apart: one of them.
    repeated = met.where("stays").groupBy(*key).agg(F.min_by("row", F.xxhash64(*(F.col("row")[c] for c in docs.columns))).alias("row")).select("row.*")
    return alone.unionByName(repeated)


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component among near duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 75 * (a.n + b.n - k)
), ways AS (
  SELECT u, v FROM e UNION ALL SELECT v, u FROM e
), reach(doc_id, c) AS (
  SELECT u, v FROM ways UNION SELECT r.doc_id, w.v FROM reach r JOIN ways w ON r.c = w.u
), least_of AS (
  SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id, least(d.doc_id, coalesce(c, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)"""


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component_id) by comparing all pairs of word tuples."""
    sets = {}
    for i, t in rows:
        ws = (t or "").encode().translate(LOWER).split()
        sets[i] = {tuple(ws[j : j + WORDS]) for j in range(max(1, len(ws) - WORDS + 1))} if ws else set()
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and BOTTOM * len(sets[a] & sets[b]) >= TOP * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}
