"""Forced-boundary encoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from conftest import SF

from tidewright.llm import bpe, queries


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.bpe_path())


def ids_of(texts):
    ids, n = bpe.fragments(bpe.bpe_path()).encode([t.encode() for t in texts])
    ends = np.concatenate(([0], np.cumsum(n)))
    return [ids[i:j].tolist() for i, j in zip(ends[:-1], ends[1:], strict=True)]


HARD = [
    "", " ", "  ", "\n", " \n", "\n ", "a", " a", "  a", "a  b", "a \n b", "a\n\n b", "a \n", "x\t\ty", "x \t", " a", "a  b", "   x",
    "don't", "'s", " 's", "''s", "'s's", "x's", "I'm he'll we've you're she'd isn't", "'sx", "'rex", "'re", "'r", "'l", "'ll", "'v e", "it'S", "1's", "\n's", "a'\n", "'", "' ", "'é", "''", "\"'t", "don't'", "'tis",
    "abc123def", "12 345,678.90", "a1!b2?", "!!! ???", "...'s...", "日本語テキスト。カタカナ", "naïve café ÄÖÜß", "😀😀 🇩🇪 é", "\u0000\u0001\u007f", "՘ᛮ²½", "https://example.org/a_b?c=d#e",
    "<|endoftext|>", "a<|endoftext|>b", "  <|endoftext|>  x", "<|endoftext|><|endoftext|>", "<|endoftext|", "x <|endoftext|>'s", "a" * 3000, "ab" * 700 + "'s", "é" * 500,
]


def test_hard_texts_one_by_one_and_together(library):
    want = [library.encode(t, add_special_tokens=False).ids for t in HARD]
    assert ids_of(HARD) == want
    assert [ids_of([t])[0] for t in HARD] == want
    own = bpe.Fragments(bpe.bpe_path())
    assert [own.decode(np.array(i, np.int64)) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want] == HARD


def test_random_texts(library):
    rng = random.Random(3)
    signs = "aab stmdrevl '\"  \n\t.,!-_12 9éßñ日本の 　😀́<|"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x250, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(40)) for _ in range(300)]
    assert ids_of(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_texts_in_runs(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 40)
    monkeypatch.setattr(bpe, "IDS", 7)
    rng = random.Random(6)
    texts = ["".join(rng.choice(["word", " ", "  ", ". ", "\n", "'s", "é ", "<|endoftext|>", "12", " x", "\u3000"]) for _ in range(n)) for n in (0, 3, 50, 400, 1, 900)] + ["x" * 500]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(texts) == want
    assert [bpe.fragments(bpe.bpe_path()).decode(np.array(i, np.int64)) for i in want] == texts


def test_never_joined_pairs_are_in_no_token(library):
    own = bpe.Fragments(bpe.bpe_path())
    tokens = [t for i, t in own.bytes_of.items() if t not in own.special]
    inside = {t[k : k + 2] for t in tokens for k in range(len(t) - 1)}
    assert all(own.never[a << 8 | b] == (bytes((a, b)) not in inside) for a in range(256) for b in range(256))
    assert 0.5 < own.never.mean() < 1
    w = own.cut([b"one two2three, and more"])
    assert [w.word(i) for i in range(len(w.start))][:3] == [b"one", b" two", b"2"]


def test_memory_is_bounded(library, monkeypatch):
    from tidewright.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(tokens, "POOLED", 100)
    own, rng = bpe.Fragments(bpe.bpe_path()), random.Random(4)
    for _ in range(30):
        text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 30))) for _ in range(40))
        assert own.encode([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(own.known) <= 50 + 40


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Fragments(bpe.tokenizer_path("word_bpe_49k.json"))


def test_rows(spark, library):
    schema = "doc_id long, text string, ids string, n_tokens int"
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "a b", None, None), (3, "a b", None, None), (None, "don't<|endoftext|>", "y", 2), (5, "long words " * 30_000, "z", 3)]
    df = spark.createDataFrame(rows, schema)
    got = bpe.encoded(df).collect()
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got) == sorted((r[0] or 0, library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
    back = bpe.decoded(bpe.encoded(df)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert bpe.encoded(df.limit(0)).count() == 0
    assert bpe.decoded(spark.createDataFrame([(1, None), (2, [220, 50256])], "doc_id long, ids array<int>")).orderBy("doc_id").collect() == [(1, None), (2, " <|endoftext|>")]
    broken = library.encode("é😀", add_special_tokens=False).ids[:2]
    assert bpe.decoded(spark.createDataFrame([(1, broken)], "doc_id long, ids array<int>")).first()["text"] == library.decode(broken, skip_special_tokens=False)


def test_query(spark, library):
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids, x = library.encode(r["text"] or "", add_special_tokens=False).ids, got[r["doc_id"]]
        assert x["n_tokens"] == len(ids) and x["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
