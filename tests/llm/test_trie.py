"""The prefix trie against one that is built node by node."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from conftest import SF, same_rows

from tidewright.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, owner string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), role or "", text or ""))
    for v in turns.values():
        v.sort(key=lambda x: (x[0], hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        whole = [x[1:] for x in turns.get(c - c % 20, [])[:h] + turns[c][h:]]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = lambda x: [y for y in members if len(y) == len(x) + 1 and y[: len(x)] == x]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", x[-1][1])) for x in below if x)
        out.append((m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(kids(node)), sum(not kids(x) for x in below), saved, hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return [tuple(r[c] for c in COLUMNS) for r in trie.trie(trie.rebuilt(trie.turns_of(df))).collect()]


def test_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 65), 100, 117, 140, 1000, 10**12 + 3]:
        for t in range(rng.choice((0, 1, 2, 3, 6))):
            rows.append((c, t, rng.choice(("user", "assistant")), rng.choice(("hello there", "yes", "", "no\tway  out"))))
    rows += [(7, None, None, None), (7, None, "user", None), (9, 3, None, "x y"), (9, 3, None, "x y"), (9, 3, "user", "tie"), (None, 1, "user", "lost"), (4, 50, "", "user"), (5, 50, "user", "")]
    rng.shuffle(rows)
    assert Counter(found(spark, rows)) == Counter(plain(rows))


def test_one_conversation_very_often(spark, monkeypatch):
    """Members in several chunks, more than salts, and long conversations."""
    monkeypatch.setattr(trie, "CHUNK", 16)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 300) for t in range(5)]
    rows += [(c, t, "user", f"other {c}" if t > 3 else f"turn {t}") for c in range(300, 320) for t in range(7)]
    rows += [(400, t, "user", "long") for t in range(300)]
    assert Counter(found(spark, rows)) == Counter(plain(rows))


def test_turnless_and_empty(spark):
    # Conversations whose own turns all give way to a head that is not there.
    rows = [(c, 0, "user", "a") for c in range(21, 40)]
    got = found(spark, rows)
    assert Counter(got) == Counter(plain(rows)) and got
    assert found(spark, []) == []


def test_query(spark, duck):
    got = queries.QUERIES["op13_trie"](spark, SF)
    same_rows(got, duck.sql(queries.ORACLES["op13_trie"]))
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == Counter(plain(rows))
