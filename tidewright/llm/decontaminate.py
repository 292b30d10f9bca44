"""Benchmark decontamination by suffix arrays over the training words.

Each task turns its documents into shards of word numbers and builds a suffix
array of every shard (prefix doubling, as deep as the longest benchmark item).
Every suffix of every item is then searched in it, one word at a time: two
binary searches narrow the range of suffixes that begin with the words so far.
Where the range goes empty the longest verbatim match ends; the range before
holds its locations. A range that reaches the window length gives the places
of that window.

Words that no item has end a suffix: they are one number, 0, that matches
nothing, and suffixes that begin with one are left out of the array.

The benchmark reaches the tasks in blocks of at most BLOCK_BYTES of text, each
a broadcast of its own, so one block at most is collected at a time. Workers
keep all of them, so a benchmark of more than MOST_BYTES raises an error:
decontaminate by parts of it, one after the other.

Defined cases: null and empty texts have no words and are never hit; an item
of fewer words than a window, but not none, is one window; items with one id
count once, and those without an id are one item of the id ""; a very long
text is a shard of its own; repeated documents are judged row by row; no items:
nothing is hit; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, slices, table

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_BYTES, MOST_BYTES = 8_000_000, 256_000_000
#: A-Z lower-cased; bytes 0-2F, 3A-60, 7B-7F (after lower-casing) part words.
SPLIT = bytes((b + 32 if 65 <= b <= 90 else b) if 0x30 <= b <= 0x39 or 65 <= b <= 90 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(SPLIT).split()


class Block:
    """The suffixes of some items: rows of word numbers, ended by -1."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.ids = ["" if i is None else str(i) for i, _ in items]
        number = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int32) for _, ws in items]
        self.item = np.concatenate([np.full(len(x), i) for i, x in enumerate(number)] or [np.zeros(0, int)])
        self.at = np.concatenate([np.arange(len(x)) for x in number] or [np.zeros(0, int)])
        self.words = np.concatenate([*number, np.zeros(0, np.int32)])
        self.left = np.concatenate([np.arange(len(x), 0, -1) for x in number] or [np.zeros(0, int)])
        size = np.array([len(x) for x in number], int)[self.item] if len(self.item) else np.zeros(0, int)
        #: Words a window has at this suffix; 0: no window begins here.
        self.window = np.where(self.left >= window, window, np.where((self.at == 0) & (size < window), size, 0))
        self.depth = int(self.left.max(initial=0))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places in ids, but those of 0, sorted by the words from there to the first 0, at least depth words deep."""
    sa = np.flatnonzero(ids)
    if not len(sa):
        return sa
    rank, k = ids.astype(np.int64), 1
    while True:
        after = np.zeros(len(ids), np.int64)
        after[:-k or None] = rank[k:] if k < len(ids) else 0
        key = rank[sa] << 32 | after[sa]
        order = np.argsort(key, kind="stable")
        sa, key = sa[order], key[order]
        new = np.concatenate(([1], (key[1:] != key[:-1]).astype(np.int64))).cumsum()
        k *= 2
        if k >= depth or new[-1] == len(sa):
            return sa
        rank = np.zeros(len(ids), np.int64)
        rank[sa] = new


def _bound(word: np.ndarray, sa: np.ndarray, d: int, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """Binary search, for all queries at once, of the first suffix in [lo, hi) whose word d is not below (right: above) want."""
    lo, hi = lo.copy(), hi.copy()
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) >> 1
        seen = word[sa[mid] + d]
        below = seen <= want[open_] if right else seen < want[open_]
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
    return lo


def search(ids: np.ndarray, sa: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """For each suffix of the block: words of its longest match, and the range in sa that holds the places; then (suffix, places) of each window that occurs."""
    n = len(block.words)
    lo, hi, longest = np.zeros(n, np.int64), np.full(n, len(sa)), np.zeros(n, np.int64)
    word = np.concatenate((ids, np.zeros(block.depth + 1, ids.dtype)))
    active, found = np.arange(n) if len(sa) else np.zeros(0, int), []
    for d in range(block.depth):
        active = active[block.left[active] > d]
        if not len(active):
            break
        want = block.words[active + d]
        a = _bound(word, sa, d, lo[active], hi[active], want, False)
        b = _bound(word, sa, d, a, hi[active], want, True)
        some = b > a
        active = active[some]
        lo[active], hi[active], longest[active] = a[some], b[some], d + 1
        found += [(int(q), sa[lo[q] : hi[q]]) for q in active[block.window[active] == d + 1]]
    return longest, lo, hi, found


def blocks_of(benchmark: DataFrame, window: int = WINDOW) -> list:
    """The benchmark as broadcasts of at most BLOCK_BYTES each (a longer item is its own block)."""
    sc, out, items, size = benchmark.sparkSession.sparkContext, [], [], 0
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > MOST_BYTES:
        raise ValueError(f"{total} bytes of benchmark; at most {MOST_BYTES} at a time")
    for item, text in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        raw = text.encode()
        if ws := words(raw):
            items.append((item, ws))
            size += len(raw)
        if size >= BLOCK_BYTES:
            out.append(sc.broadcast(Block(items, window)))
            items, size = [], 0
    return [*out, sc.broadcast(Block(items, window))] if items or not out else out


def judged(texts: list[list[bytes]], blocks: list, window: int = WINDOW) -> dict[str, object]:
    """One shard: for each document, words, words hit, items met, and its longest verbatim match."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # a 0 ends each document
    hit = np.zeros(starts[-1] + 1, np.int64)
    longest, longest_item, longest_at = np.zeros(len(texts), np.int64), [None] * len(texts), [None] * len(texts)
    items: list[set[str]] = [set() for _ in texts]
    for broadcast in blocks:
        block = broadcast.value
        get, numbers = block.vocabulary.get, np.zeros(starts[-1], np.int32)
        for t, s in zip(texts, starts, strict=False):
            numbers[s : s + len(t)] = np.fromiter((get(w, 0) for w in t), np.int32, len(t))
        sa = suffix_array(numbers, block.depth)
        length, lo, hi, found = search(numbers, sa, block)
        for q, places in found:
            np.add.at(hit, places, 1)
            np.add.at(hit, places + block.window[q], -1)
            for d in np.unique(np.searchsorted(starts, places, "right") - 1):
                items[d].add(block.ids[block.item[q]])
        for q in np.argsort(-length, kind="stable"):
            if length[q] < window:
                break
            places = sa[lo[q] : hi[q]]
            doc = np.searchsorted(starts, places, "right") - 1
            for d, p in zip(*np.unique(doc, return_index=True), strict=True):
                if length[q] > longest[d]:
                    longest[d], longest_item[d], longest_at[d] = length[q], block.ids[block.item[q]], int(places[p] - starts[d])
    inside = np.concatenate(([0], np.cumsum(np.cumsum(hit[:-1]) > 0)))
    return {"n_words": sizes, "n_hit": inside[starts[1:] - 1] - inside[starts[:-1]], "items": items, "longest": longest, "longest_item": longest_item, "longest_at": longest_at}


def shards(texts: Iterator[bytes]) -> Iterator[list[list[bytes]]]:
    """The words of texts in runs of SHARD_WORDS or a little more."""
    held, size = [], 0
    for t in texts:
        held.append(words(t))
        size += len(held[-1])
        if size >= SHARD_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items (sorted ids), longest (words of the longest verbatim match), longest_item, longest_at (its first word here). No shuffle."""
    blocks = blocks_of(benchmark, window)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            done = 0
            for texts in shards(bytes_of(b.column("text"))):
                x = judged(texts, blocks, window)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(done, len(texts)), "n_words": x["n_words"], "n_hit": x["n_hit"], "n_items": pa.array([len(i) for i in x["items"]], pa.int64()), "items": pa.array([sorted(i) for i in x["items"]], pa.list_(pa.string())), "longest": x["longest"], "longest_item": pa.array(x["longest_item"], pa.string()), "longest_at": pa.array(x["longest_at"], pa.int64())})
                done += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items array<string>, longest long, longest_item string, longest_at long")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window of any item, all columns kept, each row judged by itself. No shuffle."""
    blocks = blocks_of(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keep: list[bool] = []
            for texts in shards(bytes_of(b.column("text"))):
                keep += (judged(texts, blocks, window)["n_hit"] == 0).tolist()
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words inside benchmark windows, and the items met."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), met AS (
  SELECT doc_id, i, g.n, item_id FROM grams g JOIN windows w ON g.n = w.n AND g.gram = w.gram
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM met) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, int, str]]:
    """What op2 returns for small tables, by comparing words at every place."""
    wanted: dict[tuple, set] = {}
    for item, text in items:
        ws = words((text or "").encode())
        for i in range(max(1, len(ws) - window + 1) if ws else 0):
            wanted.setdefault(tuple(ws[i : i + window]), set()).add("" if item is None else str(item))
    out = {}
    for doc, text in docs:
        ws, hit, met = words((text or "").encode()), set(), set()
        for n in {len(x) for x in wanted}:
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in wanted:
                    hit.update(range(i, i + n))
                    met |= wanted[tuple(ws[i : i + n])]
        out[doc] = (len(ws), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest())
    return out
