"""Whole texts to token ids with a public tokenizer file."""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np

from .common import LOWER
from .words import A, B, C, SHORT, Spans, Words, mixed, parting

#: Words whose ids are remembered by a worker process (all are forgotten when there are more), and slots of its quick table.
REMEMBERED, SLOT_BITS = 250_000, 20
#: Ids of remembered words: where very long words make more, all are forgotten too.
POOLED = 8_000_000
#: Bytes that part words in this use: only what the tokenizer drops between words in any case.
BLANKS = parting(b" \n")
#: Plain letters, which the normalizer leaves as they are and no pattern parts: a-z and those of UTF-8 C3 A0 to C3 BF but the division sign.
PLAIN = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
#: For each byte: 0 in plain letters, 1 for ASCII marks, 2**32 for all others; sums over a word tell what it holds.
_SORT = np.full(256, 1 << 32, np.int64)
_SORT[list(set(PLAIN.encode()))] = 0
_SORT[[b for b in range(33, 127) if not chr(b).isalnum()]] = 1


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def by_words(tokenizer) -> bool:
    """Whether a text's ids are those of its blank-parted words, one after the other, letter case aside: the tokenizer lower-cases, drops white space between its pieces, and nothing else looks across it."""
    d = json.loads(tokenizer.to_str())
    steps = (d.get("normalizer") or {}).get("normalizers", [])
    parts = (d.get("pre_tokenizer") or {}).get("pretokenizers", [])
    known = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in steps) and any(s["type"] == "Lowercase" for s in steps)
    drops = bool(parts) and parts[0]["type"] == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and parts[0]["pattern"].get("Regex", "").endswith("[^\\s\\p{L}\\p{N}]+")
    rest = all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in parts[1:])
    return known and drops and rest and not d.get("truncation") and not d.get("padding")


def parted(w: Words) -> np.ndarray:
    """Parts words of plain letters with ASCII marks after them into both; returns whether each word is plain letters alone."""
    seen = np.concatenate(([0], np.cumsum(_SORT[np.frombuffer(w.joined, np.uint8)])))
    end = w.start + w.length
    marks = seen[end] - seen[w.start]
    plain = marks == 0
    at = np.flatnonzero((marks > 0) & (marks < w.length))
    at = at[seen[end[at]] - seen[end[at] - marks[at]] == marks[at]]  # all of them last
    extra = np.zeros(len(marks), np.int64)
    extra[at] = 1
    first = np.concatenate(([0], np.cumsum(1 + extra)))
    start, length, alone = (np.repeat(x, 1 + extra) for x in (w.start, w.length, plain))
    head = first[at]
    length[head] -= marks[at]
    start[head + 1] += length[head]
    length[head + 1] = marks[at]
    alone[head] = True
    w.start, w.length, w.first = start, length, first[w.first]
    return alone


class Memory:
    """The ids of words that a worker has met: those of at most SHORT bytes are found in a table of slots by their bytes, others and those not there in a dictionary. All are forgotten where there are too many."""

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0
        self.at, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)
        slots = 1 << SLOT_BITS
        self.one, self.two, self.length, self.entry = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)

    def learn(self, words: list[bytes], plain: list[bytes]) -> None:
        """Finds the ids of words not known and keeps them."""
        raise NotImplementedError

    def keep(self, words: list[bytes], found: list[list[int]]) -> None:
        k, size = len(self.known), np.fromiter(map(len, found), np.int32, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while k + len(size) > len(self.at):
            self.at, self.size = np.concatenate((self.at, np.zeros_like(self.at))), np.concatenate((self.size, np.zeros_like(self.size)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[k : k + len(size)], self.size[k : k + len(size)] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)
        self.known.update(zip(words, range(k, k + len(size)), strict=True))

    def entries(self, w: Spans, plain: np.ndarray) -> np.ndarray:
        """The number of each word among those remembered; plain: whether it is plain letters alone."""
        one, two, n = w.keys()
        slot = (mixed(one * A + two * B + n.astype(np.uint64) * C) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = self.entry[slot]
        missed = np.flatnonzero((self.one[slot] != one) | (self.two[slot] != two) | (self.length[slot] != n) | (n > SHORT))
        if len(missed):
            start = w.start[missed]
            found = [w.joined[i:j] for i, j in zip(start.tolist(), (start + n[missed]).tolist(), strict=True)]
            if len(self.known) > REMEMBERED or self.used > POOLED and len(self.known):
                self.forget()
                return self.entries(w, plain)
            if new := dict(x for x in zip(found, plain[missed].tolist(), strict=True) if x[0] not in self.known):
                self.learn([x for x, p in new.items() if not p], [x for x, p in new.items() if p])
            out[missed] = np.fromiter(map(self.known.__getitem__, found), np.int32, len(found))
            short = missed[n[missed] <= SHORT]
            at = slot[short]
            self.one[at], self.two[at], self.length[at], self.entry[at] = one[short], two[short], n[short], out[short]
        return out

    def gathered(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words numbered e, one after the other, and where each word's begin (and the last's end)."""
        size = self.size[e].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(size)))
        return self.pool[np.repeat(self.at[e] - total[:-1], size) + np.arange(total[-1])], total


class Encoder(Memory):
    """encode(texts): the ids of each text, no special tokens added.

    Where by_words() holds, a word seen before needs no second encoding. A text
    that may hold a special token's string is encoded in one go; so is every
    text where by_words() does not hold.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.quick = by_words(self.tokenizer)
        # Plain letters as the model sees them.
        self.seen_as = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in PLAIN} if self.quick else {}
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def learn(self, words: list[bytes], plain: list[bytes]) -> None:
        """Encodes words; those of plain letters need the model alone."""
        tokenize, seen_as = self.tokenizer.model.tokenize, self.seen_as
        found = [[t.id for t in tokenize(x.decode().translate(seen_as))] for x in plain]
        for at in range(0, len(words), 20_000):
            found += [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in words[at : at + 20_000]], add_special_tokens=False)]
        self.keep([*plain, *words], found)

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids (unsigned 32-bit) of all texts, each followed by `end` if given; and how many each has."""
        w = Words(texts, BLANKS)
        alone: list[int] = []
        if not self.quick or any(x in w.joined for x in self.special):
            alone = [i for i, t in enumerate(texts) if not self.quick or any(x in t.translate(LOWER) for x in self.special)]
            w = Words([b"" if i in set(alone) else t for i, t in enumerate(texts)], BLANKS)
        plain = parted(w)
        ids, total = self.gathered(self.entries(w, plain))
        ends = total[w.first]
        if alone or end is not None:
            rest = [np.array([end], np.uint32)] if end is not None else []
            given = dict(zip(alone, self.whole([texts[i] for i in alone]), strict=True))
            if given or len(texts) < 50:
                parts = [[given[i] if i in given else ids[ends[i] : ends[i + 1]], *rest] for i in range(len(texts))]
                counts = np.array([sum(map(len, p)) for p in parts], np.int64)
                return np.concatenate([x for p in parts for x in p] or [ids]), counts
            return np.insert(ids, ends[1:], end), np.diff(ends) + 1
        return ids, np.diff(ends)

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of one text."""
        return self.encode([text])[0].astype("<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
