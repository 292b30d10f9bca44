"""Language identification of texts that may mix languages.

1. Script ranges: every letter's code point has a script; a word's script is
   that of its first letter. Only languages that the training texts show in
   that script (SCRIPT_SHARE of their letters or more) are candidates for the
   word; if there is none, all are.
2. Per-word scores: the log probabilities of the word's letter trigrams, its
   edges included, under each language (hashed to FEATURES classes, counts of
   all training texts).
3. Viterbi: the best sequence of languages over the words of a text, where
   each change costs SWITCH, labels the spans. The language with the most
   letters is the text's; its share of the letters is the score.

Counts for all training texts are summed by Spark; the model that reaches the
tasks holds a number for each language and class, whatever the corpus's size.

Defined cases: a null text and a text without a letter (marks alone are none)
are `und`, score 0; of languages with equally many letters the first by name;
without any training text every text is `und`; a very long text is judged
whole, with memory in proportion to its words; repeated rows are judged row by
row; more than LANGUAGES different labels raise an error; an empty table gives
an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, slices, table

FEATURES, SWITCH, SCRIPT_SHARE, SMOOTH, UNKNOWN = 1 << 15, 10.0, 0.01, 0.1, "und"
CHUNK, MARK = 1_000_000, 1 << 24
#: Most languages that a model may have: it holds 2**15 numbers for each, at the driver and in every worker.
LANGUAGES = 500
#: First code points of ranges, and their scripts.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1400, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1900, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
)
NAMES = sorted({name for _, name in SCRIPTS})
_FIRST, _SCRIPT = np.array([a for a, _ in SCRIPTS]), np.array([NAMES.index(s) for _, s in SCRIPTS])


@cache
def _letters() -> np.ndarray:
    """For each code point its small letter (a mark: itself above MARK), or 0 for what is no letter or mark."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if (sort := unicodedata.category(c)[0]) == "L":
            out[i] = ord(low) if len(low := c.lower()) == 1 else i
        elif sort == "M":
            out[i] = i + MARK
    return out


class Words:
    """The words of some texts: runs of letters and of marks after a letter. begin and end in code points of all texts together; doc: the text's number."""

    def __init__(self, texts: list[bytes]):
        parts = [np.frombuffer(t.decode(errors="replace").encode("utf-32-le", "replace"), np.uint32) for t in texts]
        self.base = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))).astype(np.int64)
        raw = np.zeros(self.base[-1] + 1, np.uint32)
        for p, b in zip(parts, self.base, strict=False):
            raw[b : b + len(p)] = p
        low = _letters()[raw]
        mark = low >= MARK
        last = np.maximum.accumulate(np.where(mark, 0, np.arange(len(low))))  # the place of the last that is no mark
        inside = (low > 0) & ~mark
        inside |= mark & inside[last]
        low = np.where(inside, low, 0)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        self.begin, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.base, self.begin, "right") - 1
        self.script = _SCRIPT[np.searchsorted(_FIRST, raw[self.begin], "right") - 1]
        # At each letter, and at the place after a word: the trigram that ends there.
        one, two = np.concatenate(([0], low[:-1])), np.concatenate(([0, 0], low[:-2]))
        two[one == 0] = 0
        h = (low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (one.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (two.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        self.feature = (h >> np.uint64(40)).astype(np.int64) & (FEATURES - 1)

    def places(self) -> np.ndarray:
        """The places of all trigrams: letters and ends of words."""
        mark = np.zeros(len(self.feature) + 1, np.int8)
        mark[self.begin] += 1
        mark[self.end + 1] -= 1
        return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def chunks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(docs: DataFrame) -> dict:
    """The model of the labelled texts of docs (text, lang): languages, log probabilities, scripts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in slices(batches, size=4 * CHUNK):
            by: dict[str, list[bytes]] = {}
            for lang, t in zip(b.column("lang").to_pylist(), bytes_of(b.column("text")), strict=True):
                by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                own = total.setdefault(lang, np.zeros(FEATURES + len(NAMES), np.int64))
                for part in chunks(iter(texts)):
                    w = Words(part)
                    own[:FEATURES] += np.bincount(w.feature[w.places()], minlength=FEATURES)
                    own[FEATURES:] += np.bincount(w.script, w.end - w.begin, len(NAMES)).astype(np.int64)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "feature": pa.array(at, pa.int64()), "n": own[at]})

    labelled = docs.select("lang", "text").where("lang is not null and text is not null")
    counts = labelled.mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    found = counts.limit(LANGUAGES * (FEATURES + len(NAMES)) + 1).toArrow()
    if len(pc.unique(found.column("lang"))) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: lang does not hold language names")
    found = found.to_pydict()
    langs = sorted(set(found["lang"]))
    n = np.zeros((len(langs), FEATURES + len(NAMES)))
    n[np.searchsorted(langs, found["lang"]) if langs else [], found["feature"]] = found["n"]
    grams, letters = n[:, :FEATURES] + SMOOTH, n[:, FEATURES:]
    logp = np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32)
    return {"langs": langs, "logp": np.ascontiguousarray(logp.T), "scripts": letters >= SCRIPT_SHARE * np.maximum(letters.sum(1, keepdims=True), 1)}


def viterbi(scores: np.ndarray, doc: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word (words x languages; doc: ascending numbers): all texts advance together, one word at a time."""
    n, k = scores.shape
    if k == 1 or not n:
        return np.zeros(n, np.int64)
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    length = np.diff(np.concatenate((first, [n])))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    open_ = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # texts that have a word t
    came = np.zeros((n, k), np.int8 if k < 127 else np.int16)
    g = scores[first].astype(np.float64)
    own = np.arange(k, dtype=came.dtype)
    for t in range(1, length[0]):
        m = open_[t]
        h = g[:m]
        best = h.argmax(1)
        jump = h[np.arange(m), best] - switch
        moves = jump[:, None] > h
        came[first[:m] + t] = np.where(moves, best[:, None].astype(came.dtype), own)
        g[:m] = np.where(moves, jump[:, None], h) + scores[first[:m] + t]
    out = np.zeros(n, np.int64)
    now = g.argmax(1)
    for t in range(length[0] - 1, -1, -1):
        m = open_[t]
        at = first[:m] + t
        out[at] = now[:m]
        now[:m] = came[at, now[:m]] if t else now[:m]
    return out


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])


def judged(texts: list[bytes], model: dict, switch: float = SWITCH) -> tuple[list[str], np.ndarray, pa.Array]:
    """Language, score and spans of each text."""
    langs, w = model["langs"], Words(texts)
    pred, score = np.full(len(texts), -1), np.zeros(len(texts))
    bounds, spans = np.zeros(len(texts) + 1, np.int32), pa.array([], SPAN)
    if len(langs) and len(w.begin):
        at = w.places()
        begin = np.searchsorted(at, w.begin)
        s = np.add.reduceat(model["logp"][w.feature[at]], begin, axis=0)
        allowed = model["scripts"].T[w.script]
        s = np.where(allowed | ~allowed.any(1, keepdims=True), s, np.float32(-1e6))
        label = viterbi(s, w.doc, switch)
        letters = np.zeros((len(texts), len(langs)))
        np.add.at(letters, (w.doc, label), w.end - w.begin)
        some = letters.sum(1) > 0
        pred = np.where(some, letters.argmax(1), -1)
        score = letters.max(1) / np.maximum(letters.sum(1), 1)
        new = np.flatnonzero(np.concatenate(([True], (w.doc[1:] != w.doc[:-1]) | (label[1:] != label[:-1]))))
        last = np.concatenate((new[1:], [len(label)])) - 1
        base = w.base[w.doc[new]]
        spans = pa.StructArray.from_arrays([pa.array(w.begin[new] - base), pa.array(w.end[last] - base), pa.array([langs[i] for i in label[new]], pa.string())], fields=list(SPAN))
        bounds = np.searchsorted(w.doc[new], np.arange(len(texts) + 1)).astype(np.int32)
    return [langs[i] if i >= 0 else UNKNOWN for i in pred], score, pa.ListArray.from_arrays(pa.array(bounds), spans)


def identify(docs: DataFrame, model: dict, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans: start, end, lang in code points) of every row of docs (doc_id, text). No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, size=CHUNK):
            pred, score, spans = judged(list(bytes_of(b.column("text"))), shared.value, switch)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), spans], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>")


def of_one_language(docs: DataFrame, model: dict, share: float, switch: float = SWITCH) -> DataFrame:
    """The rows of docs of which one language has that share of the letters, all columns kept, each row judged by itself; a model without languages rejects only texts without a letter. No shuffle."""
    if not model["langs"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, size=CHUNK):
            pred, score, _ = judged(list(bytes_of(b.column("text"))), shared.value, switch)
            yield b.filter(pa.array([p != UNKNOWN and s >= share for p, s in zip(pred, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """identify() by a model of the rows that are not held out."""
    return identify(docs, train(docs.where(~held_out())))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    found = languages(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["lang"])), ",")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"), spans.alias("spans"))
