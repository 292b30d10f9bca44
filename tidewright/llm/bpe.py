"""Byte-level BPE by forced boundaries, and back to text.

A pair of bytes that stands next to one another inside no token of the
vocabulary can be joined by no merge, so every text may be cut between such
bytes: which merges happen on one side never depends on the other. The 65,536
pairs are looked up once for each tokenizer. Cuts inside the pieces that the
tokenizer's own pattern makes give short fragments, and a fragment's ids are
those of the merges within it; a text's ids are its fragments' ids, one after
the other. Few different fragments make up very many texts, so a worker
remembers a bounded number of them (tokens.Memory).

The pattern (contractions; a blank with letters, digits or marks after it; runs
of white space) needs no regular expression: a piece begins where the class
of a character changes, and what a blank, the end of white space and an
apostrophe alone do is decided by neighbours. Classes of characters are asked
of the tokenizer, each character once.

Encoding and decoding keep rows where they are: no shuffle.

Defined cases: a null or empty text has no ids and decodes to the empty text;
a special token's string is that token; repeated rows are encoded each; null
ids decode to null, and bytes that are no UTF-8 to U+FFFD; a very long text is
worked on in runs that end with a word (whole, if it has no blank); an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, slices, table
from .tokens import Memory, tokenizer_path
from .words import SHORT, Spans

#: Bytes of text that are encoded at once, and ids that are decoded at once.
CHUNK, IDS = 500_000, 100_000
#: Where a longer text may be parted: before a blank that ends a word, a piece begins whatever is around.
WORD_END = re.compile(rb"[A-Za-z0-9.,](?= )")
#: Classes of characters; UNKNOWN: not yet asked for.
SPACE, LETTER, DIGIT, MARK, UNKNOWN = 0, 1, 2, 3, 255
BLANK, APOSTROPHE = 32, 39
#: What follows the apostrophe of a contraction.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


def alphabet() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: its own where that can be seen, else the next one from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Fragments(Memory):
    """encode(texts) and decode(ids) of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        d = json.loads(tokenizer.to_str())
        pre, model = d["pre_tokenizer"] or {}, d["model"]
        added = d["added_tokens"]
        if d["normalizer"] or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or pre.get("type") != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path} is no plain byte-level BPE")
        self.pieces_of, self.merged = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
        self.letters = alphabet()
        byte_of = {c: b for b, c in self.letters.items()}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in tokenizer.get_vocab(with_added_tokens=False).items()}
        joined = np.zeros(1 << 16, bool)
        for t in self.bytes_of.values():
            raw = np.frombuffer(t, np.uint8).astype(np.int32)
            joined[raw[:-1] << 8 | raw[1:]] = True
        self.never = ~joined
        self.special = {t["content"].encode(): t["id"] for t in added}
        self.bytes_of |= {i: t for t, i in self.special.items()}
        # Longer ones first, as the tokenizer takes the longest at a place.
        self.parting = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.forget()

    def learn(self, words: list[bytes], plain: list[bytes]) -> None:
        letters = self.letters
        self.keep(plain, [[t.id for t in self.merged("".join(map(letters.__getitem__, w)))] for w in plain])

    def ask(self, chars: np.ndarray) -> None:
        """Finds the class of characters: what they form one piece with after a line break."""
        for c in chars.tolist():
            after = [len(self.pieces_of(f"\n{x}{chr(c)}")) == 2 for x in "a1!"]
            self.kind[c] = (LETTER, DIGIT, MARK)[after.index(True)] if any(after) else SPACE

    def begins(self, chars: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Whether a piece of the tokenizer's pattern begins at each character; head: whether a text does."""
        kind = self.kind[chars]
        if (new := np.unique(chars[kind == UNKNOWN])).size:
            self.ask(new)
            kind = self.kind[chars]
        out = head.copy()
        out[1:] |= kind[1:] != kind[:-1]
        # White space before something: its last character stands alone, or is the blank that goes with what follows.
        at = 1 + np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~head[1:])
        out[at - 1] = True
        out[at[chars[at - 1] == BLANK]] = False
        # An apostrophe that begins a piece and ends its run takes the letters of a contraction along.
        more = np.concatenate((chars, np.zeros(3, chars.dtype)))
        free = np.concatenate((~head, np.zeros(3, bool)))
        at = np.flatnonzero((chars == APOSTROPHE) & out)
        for letters in CONTRACTIONS:
            own = at
            for k, x in enumerate(letters, 1):
                own = own[(more[own + k] == ord(x)) & free[own + k]]
            out[own + 1] = False
            after = own + len(letters) + 1
            out[after[after < len(out)]] = True
        return out

    def cut(self, texts: list[bytes]) -> Spans:
        """The fragments of texts without special tokens."""
        joined = b"".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        edge = np.zeros(len(raw) + 1, bool)
        if len(raw):
            place = np.flatnonzero((raw & 0xC0) != 0x80)  # where characters begin
            head = np.zeros(len(raw) + 1, bool)
            head[at] = True
            chars = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
            edge[place[self.begins(chars, head[place])]] = True
            edge[1:-1] |= self.never[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        edge[-1] = False
        start = np.flatnonzero(edge)
        return Spans(joined + b" " * SHORT, start, np.diff(start, append=len(raw)), np.searchsorted(start, at))

    def runs(self, texts: list[bytes]) -> Iterator[tuple[int, bytes, int]]:
        """(text's number, bytes, special token after them or -1): texts without their special tokens, in runs of about CHUNK bytes where they have blanks."""
        for i, t in enumerate(texts):
            found = self.parting.split(t) if self.parting else [t]
            for part, token in zip(found[0::2], [*found[1::2], None], strict=True):
                at = 0
                while len(part) - at > CHUNK and (m := WORD_END.search(part, at + CHUNK)):
                    yield i, part[at : m.end()], -1
                    at = m.end()
                yield i, part[at:] if at else part, -1 if token is None else self.special[token]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids (unsigned 32-bit) of all texts, one after the other, and how many each has."""
        ids, counts, some, size = [], np.zeros(len(texts), np.int64), [], 0
        for run in chain(self.runs(texts), [None]):
            if some and (run is None or size + len(run[1]) > CHUNK):
                ids.append(self.encoded(some, counts))
                some, size = [], 0
            if run:
                some.append(run)
                size += len(run[1])
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), counts

    def encoded(self, runs: list[tuple[int, bytes, int]], counts: np.ndarray) -> np.ndarray:
        """The ids of runs(); adds to each text's count."""
        w = self.cut([r[1] for r in runs])
        ids, total = self.gathered(self.entries(w, np.ones(len(w.start), bool)))
        ends = total[w.first]
        after = np.array([r[2] for r in runs], np.int64)
        np.add.at(counts, [r[0] for r in runs], np.diff(ends) + (after >= 0))
        if (at := np.flatnonzero(after >= 0)).size:
            ids = np.insert(ids, ends[1:][at], after[at].astype(np.uint32))
        return ids

    def decode(self, ids: np.ndarray) -> str:
        parts = (ids[at : at + IDS].tolist() for at in range(0, len(ids), IDS))
        return b"".join(b"".join(map(self.bytes_of.__getitem__, x)) for x in parts).decode(errors="replace")


@cache
def fragments(path: str) -> Fragments:
    """One for each worker process."""
    return Fragments(path)


def bpe_path() -> str:
    return tokenizer_path("byte_bpe_50k.json")


def encoded(docs: DataFrame, path: str | None = None, back: bool = False) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text), ids as an array of integers; back: with `decoded`, the text of these ids. No shuffle."""
    path = path or bpe_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fragments(path)
        for b in slices(batches, size=CHUNK):
            ids, n = own.encode(list(bytes_of(b.column("text"))))
            ends = np.concatenate(([0], np.cumsum(n)))
            out = {"doc_id": b.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))}
            if back:
                out["decoded"] = pa.array([own.decode(ids[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * back)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows with `text` in place of `ids`: the text of the ids, special tokens included. No shuffle."""
    path = path or bpe_path()
    kept = [c for c in rows.columns if c not in ("ids", "text")]
    schema = rows.select(*kept, F.lit(None).cast("string").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fragments(path)
        for b in batches:
            texts = pa.array([own.decode(x.values.to_numpy()) if x.is_valid else None for x in b.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), texts], names=[*kept, "text"])

    return rows.select(*kept, "ids").mapInArrow(run, schema)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids, and the digests of its ids and of the text that they decode to."""
    rows = encoded(table(spark, sf_dir, "documents"), back=True)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
