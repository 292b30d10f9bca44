"""Operators against brute force, exact round trips and held-out accuracy, on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

from tidewright.llm import decontaminate, fingerprint, langid, lm, neardup, packing, pii, preference, queries, tokenfile, tokens, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, `window` int, row string, base string"


def docs_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Documents of the test data with nulls, blanks, ties, repeats, a long text, and columns named as the operators' own."""
    real = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:60]
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))
    more = [(9001, None, "en"), (9002, "", None), (9003, " \n\t ", "en"), (9004, "5", None), (9005, long, "en"), (9006, long + " end", "en"), (9007, "Ünïcödé mail a@b.co, +1 (212) 555-1234 und 4111111111111111", None), (9007, "Ünïcödé mail a@b.co, +1 (212) 555-1234 und 4111111111111111", None), (None, "no id here at all", "en")]
    rows = [(i, t, lang, None, None, "x", 1, "y", "z") for i, t, lang in real + more]
    return docs_of(spark, rows, DOCS), [(i, t) for i, t, *_ in rows]


def test_op1_edits_and_likeness(spark, odd):
    df, rows = odd
    got = fingerprint.with_next_text(df).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    after = {(i, t): order[(k + 1) % len(order)][1] for k, (i, t) in enumerate(order)}
    assert len(got) == len(rows)
    for r in got:
        assert r["next_text"] == after[(r["doc_id"], r["text"])] or r["doc_id"] == 9007
    assert fingerprint.digest(None) == fingerprint.digest("") and fingerprint.likeness(fingerprint.digest("abc abc"), fingerprint.digest("abc abc")) == 1


def test_op1_query(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_fingerprint"](spark, SF).collect()}
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    for k, (i, t) in enumerate(docs):
        after, n = docs[(k + 1) % len(docs)][1], len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        assert r["fingerprint"] == fingerprint.digest(t) and r["edited_fingerprint"] == fingerprint.digest(edited)
        assert abs(r["near_next"] - fingerprint.likeness(r["fingerprint"], fingerprint.digest(after))) < 1e-9
    better = np.mean([r["near_edited"] > r["near_next"] for r in got.values()])
    assert better > 0.9


def test_op1_ranges(spark, monkeypatch):
    """Many ranges, ids far apart, and one id whose rows fill several ranges."""
    rng = random.Random(1)
    ids = sorted(rng.sample(range(-(1 << 60), 1 << 60), 60))
    for rows in ([(i, f"t{i}") for i in ids], [(7, f"x{k}") for k in range(80)] + [(i, f"t{i}") for i in range(20)] + [(None, f"n{k}") for k in range(30)]):
        got = Counter((r["doc_id"], r["text"], r["next_text"]) for r in fingerprint.with_next_text(docs_of(spark, rows)).collect())
        low = -(1 << 63)
        down = sorted(rows, key=lambda r: (low if r[0] is None else r[0], zlib.crc32(r[1].encode()), r[1]), reverse=True)
        assert got == Counter((*r, down[(k + 1) % len(down)][1]) for k, r in enumerate(down))
    assert fingerprint.with_next_text(docs_of(spark, [(1, "alone")])).first()["next_text"] == "alone"
    assert fingerprint.with_next_text(docs_of(spark, [])).count() == 0


def test_op1_margins_by_length():
    """Edited copies are far above unrelated texts at every length."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    for n, margin in ((10, 0.5), (30, 0.5), (100, 0.4), (300, 0.3), (3000, 0.15)):
        vocabulary = [word() for _ in range(2000)]
        texts = [" ".join(rng.choice(vocabulary) for _ in range(n)) for _ in range(12)]
        digests = [fingerprint.digest(t) for t in texts]
        apart = np.mean([fingerprint.likeness(a, b) for a, b in zip(digests, digests[1:], strict=False)])
        near = np.mean([fingerprint.likeness(a, fingerprint.digest(t[: len(t) - len(t) // 3] + u[: len(t) // 3])) for a, t, u in zip(digests, texts, texts[1:], strict=False)])
        assert near > apart + margin, (n, near, apart)
        assert n > 300 or apart < 0.3, (n, apart)
    assert fingerprint.likeness(fingerprint.digest("word"), fingerprint.digest("other")) < 0.1


def test_op1_digest_by_hand():
    """Buckets, quartiles and score once more, byte by byte."""
    for text in ("", "ab", "abcabcabd", "the quick brown fox " * 40, "é日本"):
        raw, counts = text.encode(), [0] * 1024
        for i in range(len(raw) - 2):
            h = (raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 2654435761 % 2**32
            h = (h ^ h >> 15) * 2246822519 % 2**32
            counts[(h ^ h >> 13) % 1024] += 1
        order = sorted(counts)
        cuts = [order[255], order[511], order[767]]
        want = [min(255, round(8 * np.log2(len(raw) + 1)))] + [sum(c > q for q in cuts) for c in counts]
        assert fingerprint.decode(fingerprint.digest(text)).tolist() == want
    a, b = (fingerprint.decode(fingerprint.digest(t)) for t in ("some words here " * 9, "some other words " * 9))
    far = sum(abs(int(x) - int(y)) for x, y in zip(a[1:], b[1:], strict=True)) / 1024
    unrelated = sum(abs(i - j) * (a[1:] == i).mean() * (b[1:] == j).mean() for i in range(4) for j in range(4))
    assert abs(fingerprint.code_likeness(a, b) - (1 - far / unrelated - 0.016 * abs(int(a[0]) - int(b[0])))) < 1e-9


def test_op2_brute_force(spark, odd):
    df, rows = odd
    rows = [r for r in rows if r[0] != 9007]
    words = (rows[0][1] or "").split()
    items = [(None, " ".join(words[5:20])), (1, " ".join(words[3:30])), (2, "no id here"), (3, None), (4, ""), (5, "word1 and1 word2 and2 word3 and3 word4 and4 word5 and5 word6 and6"), (5, "word1 and1"), (6, (rows[5][1] or "")[:200])]
    bench = docs_of(spark, items, "item_id long, text string")
    want = decontaminate.brute_force(rows, items)
    got = {r["doc_id"]: r for r in decontaminate.contamination(df.where("doc_id is null or doc_id <> 9007"), bench).collect()}
    assert got.keys() == want.keys()
    for i, (n, hit, met, digest) in want.items():
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, met) and hashlib.sha256(",".join(r["items"]).encode()).hexdigest() == digest
    kept = {r["doc_id"] for r in decontaminate.decontaminated(df, bench).collect()}
    assert kept >= {i for i, w in want.items() if not w[1]} and not kept & {i for i, w in want.items() if w[1] and i is not None}
    assert decontaminate.contamination(df.limit(0), bench).count() == 0 and {r["n_hit"] for r in decontaminate.contamination(df, bench.limit(0)).collect()} == {0}


def test_op2_and_op6_sql(spark, duck):
    for name in ("op2_decontaminate", "op6_neardup"):
        same_rows(queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name]))


def test_op2_suffix_array_sorts():
    ids = np.random.default_rng(0).integers(0, 4, 300).astype(np.int32)
    sa = decontaminate.suffix_array(ids, 50)

    def suffix(p):
        end = np.flatnonzero(ids[p:] == 0)
        return tuple(ids[p : p + (end[0] if len(end) else len(ids))])

    assert sorted(sa) == list(np.flatnonzero(ids)) and all(suffix(a) <= suffix(b) for a, b in zip(sa, sa[1:], strict=False))


def test_op2_longest_match_spans_more_than_a_window(spark):
    text = " ".join(f"w{i}" for i in range(40))
    r = decontaminate.contamination(docs_of(spark, [(1, "x y " + text + " z")]), docs_of(spark, [(7, text)], "item_id long, text string")).first()
    assert (r["longest"], r["longest_item"], r["longest_at"], r["n_hit"]) == (40, "7", 2, 40)


def test_op3_counts_and_base(spark, odd):
    df, rows = odd
    df, rows = df.where("doc_id <> 9007"), [r for r in rows if r[0] not in (9007, None)]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    split = lambda t: lm.tokens((t or "").encode()) + [None]
    c = Counter(w for _, t in train for w in split(t))
    total = sum(c.values())
    got = {r["doc_id"]: r for r in lm.scores(df, df.where(~lm.held_out()), depth=3, bits=14).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r, ws = got[i], split(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), total)
        base = sum(np.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in ws)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
    assert {r["n_tokens"] for r in lm.scores(df.where("doc_id = 9002"), df.limit(0), depth=2, bits=12).collect()} == {1}


def tree_by_hand(texts, depth):
    """p(bit) along the path of every gram, by recursion over a dict of counts."""
    from math import exp, lgamma, log

    counts = {}
    for g in lm.grams(lm.Words(texts, lm.parting()), depth)[0].tolist():
        byte, ctx = g & 255, g >> 8
        for d in range(depth + 1):
            for j in range(8):
                k = (d, ctx & ((1 << 8 * d) - 1), 1 << j | byte >> 8 - j)
                a = counts.setdefault(k, [0, 0])
                a[byte >> 7 - j & 1] += 1
    kt = lambda a, b: lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - 2 * lgamma(0.5)
    logw, weight = {}, {}
    for d in range(depth, -1, -1):
        below = Counter()
        for (e, ctx, node), v in logw.items():
            if e == d + 1:
                below[ctx & ((1 << 8 * d) - 1), node] += v
        for (e, ctx, node), (a, b) in counts.items():
            if e == d:
                own, rest = log(0.5) + kt(a, b), log(0.5) + below[ctx, node]
                logw[e, ctx, node] = kt(a, b) if d == depth else np.logaddexp(own, rest)
                weight[e, ctx, node] = 1.0 if d == depth else exp(own - logw[e, ctx, node])

    def p(ctx, node):
        done, rest, out = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            k = (d, ctx & ((1 << 8 * d) - 1), node)
            if k not in counts:
                return out
            est = (counts[k][1] + 0.5) / (sum(counts[k]) + 1)
            out = done + rest * est
            done, rest = done + rest * weight[k] * est, rest * (1 - weight[k])
        return out

    return p


def test_op3_grams_byte_by_byte():
    texts = [b"", b"  A b\t\n", b"abcdefghi jk", b"x", b" "]
    for depth in (1, 3, 5, 7):
        got, first = lm.grams(lm.Words(texts, lm.parting()), depth)
        want, begins = [], []
        for t in texts:
            begins.append(len(want))
            stream = b"\n" * depth + b" ".join(lm.tokens(t)) + b"\n"
            for i in range(depth, len(stream)):
                want.append(int.from_bytes(stream[i - depth : i + 1], "big"))
        assert got.view(np.uint64).tolist() == want and first.tolist() == begins


def test_op3_tree_by_hand(spark):
    texts = [b"the cat sat", b"the mat sat on the cat", b"a cat"]
    p = tree_by_hand(texts, 2)
    df = docs_of(spark, [(i, t.decode()) for i, t in enumerate(texts)] + [(9, "the dog")])
    got = {r["doc_id"]: r["score"] for r in lm.scores(df, df.where("doc_id < 3"), depth=2, bits=16).collect()}
    for i, t in [*enumerate(texts), (9, b"the dog")]:
        want = 0.0
        for g in lm.grams(lm.Words([t], lm.parting()), 2)[0].tolist():
            byte, ctx = g & 255, g >> 8
            for j in range(8):
                q = p(ctx, 1 << j | byte >> 8 - j)
                want += np.log10(q if byte >> 7 - j & 1 else 1 - q)
        assert abs(got[i] - want) < 2e-3 * abs(want)


def test_op4_sql_and_edges(spark, duck):
    same_rows(queries.QUERIES["op4_preference"](spark, SF), duck.sql(queries.ORACLES["op4_preference"]))
    turns = "conv_id long, turn int, role string, text string, place string"
    a = docs_of(spark, [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "yes", "x"), (2, 0, "user", "q", "x"), (3, 0, None, None, "x"), (4, None, "user", "lost", "x"), (5, 0, "user", "alone", "x")], turns)
    b = docs_of(spark, [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "no", "x"), (1, 2, "user", "more", "x"), (2, 0, "user", "q", "x"), (3, 0, "", "", "x"), (4, 0, "user", "lost", "x")], turns)
    got = {r["conv_id"]: r for r in preference.preference_pairs(a, b).collect()}
    assert got.keys() == {1, 2, 3}
    r = got[1]
    assert r["n_prefix"] == 1 and r["prompt"] == "<|user|>\nhi<|end|>\n" and r["chosen"] == "<|assistant|>\nyes<|end|>\n"
    for side in ("chosen", "rejected"):
        (m,) = r[f"{side}_mask"]
        assert r[side][m["start"] : m["end"]] == ("yes" if side == "chosen" else "no") + "<|end|>\n"
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[3]["n_prefix"] == 1
    assert preference.preference_pairs(a.limit(0), b).count() == 0


def test_op4_repeats_and_marks(spark, duck):
    """Repeated turns are turns of their own; a text that holds marks is told apart; ties; SQL over such rows."""
    turns = "conv_id long, turn int, role string, text string"
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "a<|end|>\n<|assistant|>\nb"), (1, 1, "assistant", "zz"), (2, 0, "a|b", "<|"), (2, 1, "assistant", ""), (2, 2, "assistant", "x" * 5001), (None, 0, "user", "no id"), (3, None, "user", "no turn")]
    df = docs_of(spark, rows, turns)
    got = {r["conv_id"]: r for r in preference.preference_pairs(df, df.where("not (conv_id = 1 and text = 'q')").unionByName(docs_of(spark, [(1, 0, "user", "q")], turns))).collect()}
    assert got.keys() == {1, 2} and got[1]["n_prefix"] == 1 and got[2]["chosen"] == ""
    assert got[1]["chosen"].startswith("<|user|>\nq<|end|>\n<|assistant|>\na<||end|>\n<||assistant|>\nb<|end|>\n")
    assert got[2]["prompt"].startswith("<|a||b|>\n<||<|end|>\n")
    pair = preference.preference_pairs(docs_of(spark, [(1, 0, "user", "a<|end|>\n<|user|>\nb")], turns), docs_of(spark, [(1, 0, "user", "a"), (1, 1, "user", "b")], turns)).first()
    assert pair["n_prefix"] == 0 and pair["chosen"] != pair["rejected"]
    r = preference.formatted(preference.cut_short(df)).where("conv_id = 2").first()
    assert (r["n_prefix"], r["chosen_mask"][0]["end"] - r["rejected_mask"][0]["end"]) == (2, 2501)
    import pandas as pd

    mem = duck.cursor()
    mem.execute("CREATE SCHEMA IF NOT EXISTS op4; SET schema = 'op4'")
    mem.register("given", pd.DataFrame([r for r in rows if None not in r], columns=["conv_id", "turn", "role", "text"]))
    mem.execute("CREATE OR REPLACE TABLE op4.conversations AS SELECT * FROM given")
    out = preference.formatted(preference.cut_short(df)).select("conv_id", "n_prefix", "prompt", "chosen", "rejected").collect()
    want = mem.execute(f"SELECT conv_id, n_prefix, prompt, chosen, rejected FROM ({preference.OP4_SQL})").fetchall()
    assert sorted(map(tuple, out)) == sorted(want)


def test_pieces_are_the_tokenizers_own():
    e = tokens.Encoder(tokens.tokenizer_path())
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é.,'s <|\n\t12ÉñΣ́") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["it's we'll, x.. 'S <|ENDOFTEXT|> a", "<|endoftext|> hi", "a\tb c. É. é, 12.5. \n\n end.,x", "ß. ÿ, Σ. ΣΑΣ. İstanbul. ", "", "日本語。 text"]
    for t in texts:
        assert e.ids(t.encode()) == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_op5_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 5000):
        for top in (1, 300, 2**16, 2**32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            ids[rng.random(n) < 0.05] = 2**32 - 1
            payload = tokenfile.pack(ids)
            assert (tokenfile.unpack(payload) == ids).all()
            assert (tokenfile.unpack(payload, n // 3, n // 2) == ids[n // 3 : n // 2]).all()
    with pytest.raises(ValueError):
        tokenfile.unpack(b"XXXX" + bytes(8))


def test_op5_files(spark, odd):
    df, rows = odd
    e, at, want = tokens.Encoder(tokens.tokenizer_path()), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.frombuffer(e.ids((t or "").encode()), "<u4").tolist() + [2]
        want.append((i, at, len(ids), tokenfile.crc_of(ids)))
        at += len(ids)
    got = tokenfile.read_documents(tokenfile.write_shards(df)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokenfile.read_documents(tokenfile.write_shards(df.limit(0))).count() == 0


def test_op6_brute_force(spark, odd):
    df, rows = odd
    base = [f"w{i}" for i in range(120)]
    rng = random.Random(5)
    near = [(20_000 + k, " ".join("x%d" % rng.randrange(9) if rng.random() < p else w for w in base)) for k, p in enumerate([0, 0, 0.01, 0.02, 0.03, 0.04, 0.05] * 6)]
    rows = [r for r in rows if r[0] not in (None, 9007)] + near
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == neardup.brute_force(rows)
    kept = {r["doc_id"] for r in neardup.deduplicated(df).collect()}
    assert {9001, 9002, 9003, 9004, 9005, None} <= kept and 9006 not in kept
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_op6_blocks_find_what_one_block_finds(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 5)
    base, rng = [f"w{i}" for i in range(200)], random.Random(2)
    rows = [(k, " ".join("y%d" % rng.randrange(50) if rng.random() < 0.02 else w for w in base)) for k in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == neardup.brute_force(rows)


def test_dedup_of_repeated_ids_rows_and_no_ids(spark):
    a, b, c = "a b c d e f g h i j", "k l m n o p q r s", "only here there is a text of some words"
    rows = [(1, a, 1), (2, a, 2), (2, c, 3), (3, b, 4), (3, b, 4), (3, b, 5), (None, "x y z u v w", 6), (None, "x y z u v w", 6), (None, b, 7), (None, None, 8), (5, "", 9), (5, "", 9)]
    df = docs_of(spark, rows, "doc_id long, text string, row int")
    got = [tuple(r) for r in neardup.deduplicated(df).collect()]
    assert sorted((r[0] or 0, r[1] or "") for r in got) == sorted([(1, a), (2, c), (3, b), (0, "x y z u v w"), (0, ""), (5, ""), (5, "")])
    assert set(got) <= set(rows) and neardup.deduplicated(df).columns == df.columns


def test_op6_members_left_by_the_hub_are_compared(spark, monkeypatch):
    """Two families that share a third of their words meet at one hub; a bridge joins a third to one."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(9)
    common = [f"c{i}" for i in range(100)]
    family = lambda x: common + [f"{x}{i}" for i in range(60)]
    rows = [(100 * k + i, " ".join("z%d" % rng.randrange(99) if rng.random() < 0.01 else w for w in family(x))) for k, x in enumerate("pqr") for i in range(15)]
    chain = [f"d{i}" for i in range(300)]
    rows += [(1000 + i, " ".join(chain[12 * i : 12 * i + 120])) for i in range(12)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == neardup.brute_force(rows)


def test_op7_marks_are_no_letters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs_of(spark, [(1, "\u0301"), (2, "\u0300 12"), (3, "e\u0301te\u0301 et la maison"), (4, "e\u0301te\u0301 et la maison"), (4, "e\u0301te\u0301 et la maison")]), langid.train(docs)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got[:2]] == [("und", 0.0)] * 2 and got[2]["score"] > 0 and got[2]["spans"][0]["start"] == 0
    assert tuple(got[3])[1:] == tuple(got[4])[1:]


def test_op7_by_hand(spark):
    """Candidates by script, word scores and the best path once more, word by word."""
    import unicodedata

    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text is not null").collect()][:40]
    texts = [(r["doc_id"], r["text"][:400]) for r in docs[:12]] + [(9001, "été — 12 naïve x_y Straße"), (9002, "слово и word")]
    df = docs_of(spark, [(r["doc_id"], r["text"], r["lang"]) for r in docs], "doc_id long, text string, lang string")
    model = langid.train(df)

    def words(text):
        out, now = [], ""
        for c in text + " ":
            sort = unicodedata.category(c)[0]
            if sort == "L" or (sort == "M" and now):
                now += c
            elif now:
                out.append(now)
                now = ""
        return out

    def features(word):
        low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in word]
        low = [x + (1 << 24) if unicodedata.category(c)[0] == "M" else x for x, c in zip(low, word, strict=True)]
        seq, out = [0, 0, *low, 0], []
        for i in range(2, len(seq)):
            a, b, c = seq[i], seq[i - 1], seq[i - 2] if seq[i - 1] else 0
            h = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F ^ c * 0x165667B19E3779F9) % 2**64
            out.append(((h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64 >> 40) % (1 << 15))
        return out

    langs = sorted({r["lang"] for r in docs})
    counts = {x: Counter(f for r in docs if r["lang"] == x for w in words(r["text"]) for f in features(w)) for x in langs}
    total = {x: sum(c.values()) + 0.1 * (1 << 15) for x, c in counts.items()}
    got = {r["doc_id"]: r for r in langid.identify(docs_of(spark, texts), model).collect()}
    for i, t in texts:
        ws = words(t)
        s = np.array([[sum(np.log((counts[x][f] + 0.1) / total[x]) for f in features(w)) for x in langs] for w in ws])
        best, back = s[0], []
        for row in s[1:]:
            jump = best.max() - 10
            back.append(np.where(jump > best, best.argmax(), np.arange(len(langs))))
            best = np.maximum(best, jump) + row
        path = [int(best.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        letters = Counter()
        for w, x in zip(ws, path[::-1], strict=True):
            letters[langs[x]] += len(w)
        top = max(letters.values())
        assert abs(got[i]["score"] - top / sum(letters.values())) < 1e-9 and letters[got[i]["lang_pred"]] == top, i


def test_op7_held_out_accuracy_and_edges(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = queries.QUERIES["op7_langid"](spark, SF).where("held_out").collect()
    assert len(got) > 20 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.9
    found = {r["doc_id"]: r for r in langid.languages(odd[0]).collect()}
    for i in (9001, 9002, 9003, 9004):
        assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
    assert {r["lang_pred"] for r in langid.identify(odd[0], langid.train(odd[0].limit(0))).collect()} == {"und"}
    assert langid.languages(odd[0].limit(0)).count() == 0


def test_op7_spans_of_a_mixed_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    de, en = (next(r["text"] for r in docs.where(f"lang = '{x}' and length(text) between 300 and 900").collect()) for x in ("de", "en"))
    r = langid.identify(docs_of(spark, [(1, de + " " + en)]), langid.train(docs)).first()
    assert {s["lang"] for s in r["spans"]} == {"de", "en"}
    assert min(abs(s["start"] - len(de)) for s in r["spans"]) < 60


def test_op7_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    s, doc = rng.normal(size=(7, 3)), np.array([0, 0, 0, 0, 0, 1, 1])
    from itertools import product

    for d in (0, 1):
        own = s[doc == d]
        best = max(product(range(3), repeat=len(own)), key=lambda p: sum(own[i, k] for i, k in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        assert tuple(langid.viterbi(s, doc, 0.7)[doc == d]) == best


def test_op8_sql_and_edges(spark, duck):
    same_rows(queries.QUERIES["op8_urlfilter"](spark, SF), duck.sql(queries.ORACLES["op8_urlfilter"]))
    urls = [None, "", "no scheme", "HTTP://A.Example.ORG/es/x?q", "http://x.com", "http://porn.net/a", "http://sporn.net/", "http://a.net/free/sex", "http://a.net/free-free", "http://notorg/es/", "http://b.com/de/porn"]
    got = {r["page_id"]: r for r in urlfilter.judged(docs_of(spark, list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i]["verdict"] for i in range(11)] == ["allow", "allow", "allow", "block", "allow", "block", "allow", "block", "allow", "allow", "block"]
    assert (got[3]["host"], got[3]["path"], got[3]["rule"]) == ("a.example.org", "/es/x", "example.org/es/") and got[4]["rule"] is None


def test_op8_escapes_weights_and_tables(spark, duck):
    import pandas as pd

    urls = ["http://a.net/%70orn", "http://a.net/%50OR%4e/", "http://a.net%2Fporn", "http://a.net/%%370orn", "http://a.net/%FFporn", "http://a.net/free/download", "http://a.net/free/download/sex", "http://a.net/p%6frnx", "x%", None, "http://é.net/%C3%A9/xxx", "http://a.net/%2570orn", "http://a.net/%70orn"]
    pages = docs_of(spark, list(enumerate(urls)), "page_id long, url string")
    got = sorted(urlfilter.judged(pages).collect())
    assert [r["verdict"] for r in got] == ["block", "block", "block", "allow", "allow", "allow", "block", "allow", "allow", "allow", "block", "allow", "block"]
    mem = duck.cursor()
    mem.execute("CREATE SCHEMA IF NOT EXISTS op8; SET schema = 'op8'")
    mem.register("given", pd.DataFrame({"page_id": range(len(urls)), "url": urls}))
    mem.execute("CREATE OR REPLACE TABLE op8.pages AS SELECT * FROM given")
    want = mem.execute(f"SELECT page_id, verdict, n_strict, n_soft, soft_weight FROM ({urlfilter.OP8_SQL}) ORDER BY page_id").fetchall()
    assert [(r["page_id"], r["verdict"], len(r["strict_hits"]), len(r["soft_hits"]), r["soft_weight"]) for r in got] == want
    terms = docs_of(spark, [("Acme", True, None), ("one", None, None), ("one", False, 3.0), ("two", False, 0.25), (None, True, 1.0), ("", True, 1.0)], "term string, strict boolean, weight double")
    v = urlfilter.vocabulary_of(terms)
    assert v == urlfilter.Vocabulary(("acme",), (("one", 3.0), ("two", 0.25)))
    found = urlfilter.judged(docs_of(spark, [(1, "http://ACME.io"), (2, "http://a.io/one"), (3, "http://a.io/one-two"), (3, "http://a.io/one-two")], "page_id long, url string"), vocabulary=v).collect()
    assert [(r["page_id"], r["verdict"]) for r in found] == [(1, "block"), (2, "allow"), (3, "block"), (3, "block")]
    assert urlfilter.judged(pages.limit(0)).count() == 0 and urlfilter.judged(pages, vocabulary=urlfilter.vocabulary_of(terms.limit(0))).where("verdict = 'block'").count() == 0


def test_op9_places(spark, odd):
    df, rows = odd
    e = tokens.Encoder(tokens.tokenizer_path())
    got = packing.pack_documents(df).collect()
    by_seq, lengths = {}, Counter()
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        lengths[r["doc_id"]] += r["length"]
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    want = Counter()
    for i, t in rows:
        want[i] += len(e.ids((t or "").encode())) // 4 + 1
    assert lengths == want
    total = sum(want.values())
    assert len(by_seq) <= total / 4096 * 1.1 + 2
    assert packing.pack_documents(df.limit(0)).count() == 0
    whole = b"".join(r["ids"] for r in packing.sequences(df).collect())
    assert len(whole) == 4 * total


def test_op9_large_pieces_pair():
    for seed in range(20):
        rng = random.Random(seed)
        counts = Counter(rng.randint(1, 100) for _ in range(rng.randint(1, 300)))
        runs, used = packing.plan(dict(counts), 100)
        runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))].tolist()
        fill = {}
        for k, (length, first, seq, offset) in enumerate(runs):
            end = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == length else counts[length]
            for r in range(first, end):
                fill.setdefault(seq + r - first, []).append((offset, length))
        assert sum(map(len, fill.values())) == sum(counts.values()) and len(fill) == used
        for parts in fill.values():
            assert [o for o, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)])[:-1]) and sum(n for _, n in parts) <= 100
            assert sum(3 * n > 100 for _, n in parts) <= 2


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_op10_base_spans(spark, odd):
    rng = random.Random(4)
    made = [(30_000 + i, "".join(rng.choice(["a", "@", ".", "1", "23", "4111 1111 1111 1111", "+1", "(212)", " ", "-", "555-1234", "10.0.0.1", "é", "b.co", "_", "😀"]) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    made += [(31_000, "7" * 30_000), (31_001, "1 " * 20_000), (31_002, "a" * 50_000), (31_003, "a@" + "b." * 9000 + "c"), (31_004, "+" * 5000 + "1")]
    rows = [r for r in odd[1] if r[0] not in (None, 9007)] + made
    got = pii.personal_data(docs_of(spark, rows)).collect()
    by = {(r["doc_id"]): r for r in got}
    assert len(got) == len(rows)
    for i, t in rows:
        assert [tuple(x) for x in by[i]["base"]] == base_spans(t), i
        spans = [tuple(x) for x in by[i]["spans"]]
        assert set(base_spans(t)) <= set(spans) and spans == sorted(spans)
    assert pii.personal_data(docs_of(spark, rows).limit(0)).count() == 0


def test_op10_redaction(spark, odd):
    df, _ = odd
    out = {r["doc_id"]: r for r in pii.redacted(df).collect()}
    assert out[9007]["text"].startswith("Ünïcödé mail [EMAIL], ") and "4111" not in out[9007]["text"] and "@" not in out[9007]["text"]
    assert out[9001]["text"] is None and out[9002]["text"] == "" and list(out[9001].asDict()) == df.columns and df.count() == pii.redacted(df).count()


def test_op10_query_counts(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_pii"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want = base_spans(r["text"])
        g = got[r["doc_id"]]
        assert [g[f"n_{k}"] for k in PATTERNS] == [sum(x[1] == k for x in want) for k in range(4)]
        text = ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in want)
        assert g["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline
    from tidewright.llm.common import staged

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in rows.collect()}
        rows = staged(stage(spark, rows, SF), f"test-{name}")
        after = {r["doc_id"] for r in rows.collect()}
        if name == "near_duplicates":
            assert after == {i for i, (_, c) in neardup.brute_force(list(before.items())).items() if i == c}
        elif name == "contamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert after == {i for i, w in decontaminate.brute_force(list(before.items()), items).items() if not w[1]}
        elif name == "personal_data":
            assert after == before.keys() and not any(base_spans(r["text"]) for r in rows.collect())
        elif name == "language":
            assert len(after) >= 0.98 * len(before)
        if name != "packing":
            assert rows.columns == docs.columns
        else:
            assert after == before.keys()
    empty = odd[0].limit(0).select(*docs.columns)
    for name, stage in corpus_pipeline.STAGES:
        empty = staged(stage(spark, empty, SF), f"empty-{name}")
    assert empty.count() == 0


def test_redaction_of_any_columns_and_no_ids(spark):
    rows = [(None, "1:x a@b.co", "h", "i", "j", 1), (1, "x a@b.co", "h", "i", "j", 2), (1, "x a@b.co", "h", "i", "j", 2), (2, None, None, None, None, None)]
    df = docs_of(spark, rows, "doc_id long, text string, __row string, `all` string, spans string, n_chars int")
    got = sorted((tuple(r) for r in pii.redacted(df).collect()), key=str)
    want = [(None, "1:x [EMAIL]", "h", "i", "j", 11), (1, "x [EMAIL]", "h", "i", "j", 9), (1, "x [EMAIL]", "h", "i", "j", 9), (2, None, None, None, None, None)]
    assert got == sorted(want, key=str) and pii.redacted(df).columns == df.columns


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Repeated ids and rows, rows without id, other columns: through all stages."""
    import corpus_pipeline
    from tidewright.llm.common import staged

    real = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400").collect()][:30]
    rows = [(r["doc_id"], r["text"], r["lang"], "s", 5, "k") for r in real]
    rows += [(rows[0][0], rows[1][1] + " mehr", "de", "s", 5, "k"), rows[2], rows[2], (None, rows[3][1], "en", "s", 5, "k"), (None, "write to me at x.y@mail.net or not, as it is for the best", "en", "s", 5, "k"), (None, None, None, None, None, None), (77, "\u0301 12", None, None, None, None)]
    docs = docs_of(spark, rows, "doc_id long, text string, lang string, source string, n_chars long, key string")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before = out.count()
        out = staged(stage(spark, out, SF), f"odd-{name}")
        assert name == "packing" or (out.columns == docs.columns and out.count() <= before)
        if name == "near_duplicates":
            kept = [(r["doc_id"], r["text"]) for r in out.collect()]
            assert len(kept) == len(set(kept)) and len({t for _, t in kept}) == len(kept) and (None, rows[3][1]) not in kept
    whole = out.where("doc_id is null").collect()
    assert len(whole) == 1 and len(whole[0]["ids"]) == 4 * whole[0]["length"] and zlib.crc32(whole[0]["ids"]) == whole[0]["ids_crc32"]


def test_op3_keeps_every_node(spark, monkeypatch):
    """More nodes of a depth than 2**12, in several blocks: every score is that of the whole tree."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(400)) for _ in range(30)]
    monkeypatch.setattr(lm, "BLOCK", 3000, raising=False)
    p = tree_by_hand([t.encode() for t in texts[:25]], 3)
    df = docs_of(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["score"] for r in lm.scores(df, df.where("doc_id < 25"), depth=3, bits=12).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = 0.0
        for g in lm.grams(lm.Words([t.encode()], lm.parting()), 3)[0].tolist():
            byte, ctx = g & 255, g >> 8
            for j in range(8):
                q = p(ctx, 1 << j | byte >> 8 - j)
                want += np.log10(q if byte >> 7 - j & 1 else 1 - q)
        assert abs(got[i] - want) < 1e-5 * abs(want)


def test_op10_adds_what_base_rules_miss(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    phone = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows, planted, false = [], {}, {}
    for i in range(600):
        wrong = "4111 1111 1111 111" + rng.choice("023456789")
        form = i % 6
        text = f"{word()} {word()} " + [f"mail {word()}@{word()}.com now", f"call +1 {phone()} now", f"host 10.0.300.{rng.randint(1, 250)} now", f"card {wrong} now", f"mail {word()} [at] {word()} [dot] com now", f"call {phone()} now"][form]
        rows.append((i, text))
        start, end = text.index(" ", text.index(["mail", "call", "host", "card", "mail", "call"][form])) + 1, len(text) - 4
        if form > 3:
            planted[i] = (start, 0 if form == 4 else 3, end)
        elif form > 1:
            false[i] = (start, end)
    got = {r["doc_id"]: r for r in pii.personal_data(docs_of(spark, rows)).collect()}
    assert all(not got[i]["base"] and [tuple(x) for x in got[i]["spans"]] == [span] for i, span in planted.items())
    assert not any(got[i]["spans"] for i in false)


#: Clean numbers and words, and personal data that no base rule knows: (text, the added span's text or none).
LOOKALIKES = (
    ("order number 555-123-4567 was sent", None), ("ISBN 978 123 4567 is out of print", None), ("in 2019 555 1234 copies were sold", None), ("part 100-200-3000 fits", None),
    ("see table 12 345 6789 below", None), ("meet us [at] noon [dot] today", None), ("version 210 555-1234 of the form", None), ("call about order 555-123-4567 again", None),
    ("page 312 555-1234 and on", None), ("the sum of 415 555 1234 and more", None), ("call 415-555-1234 after six", "415-555-1234"), ("phone: (415) 555-1234 at night", "(415) 555-1234"),
    ("my mobile 212 555-9876, please", "212 555-9876"), ("write to jane.doe [at] example [dot] org soon", "jane.doe [at] example [dot] org"), ("contact joe(at)mail(dot)net now", "joe(at)mail(dot)net"),
)


def test_op10_leaves_lookalikes(spark):
    real = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/documents.parquet").select("doc_id", "text")
    rows = real.unionByName(docs_of(spark, [(10**6 + k, t) for k, (t, _) in enumerate(LOOKALIKES)]))
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in pii.personal_data(rows).where("doc_id >= 1000000").collect()}
    for k, (text, found) in enumerate(LOOKALIKES):
        assert [text[s:e] for s, _, e in got[10**6 + k]] == ([found] if found else []), text


def test_op10_thresholds_need_both_sorts():
    assert pii.threshold([(0.9, 50, 50)]) is None and pii.threshold([(0.9, 50, 0)]) is None and pii.threshold([]) is None
    assert pii.threshold([(0.9, 20, 20), (0.1, 9, 0)]) is None
    assert pii.threshold([(0.9, 20, 20), (0.6, 20, 19), (0.55, 20, 2), (0.1, 90, 0)]) == (0.6 + 0.55) / 2
    assert pii.threshold([(0.9, 20, 20), (0.05, 90, 0)]) == 0.5
    assert pii.threshold([(0.4, 20, 20), (0.1, 90, 0)]) is None
