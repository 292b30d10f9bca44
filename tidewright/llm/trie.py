"""A prefix trie of conversations, each node owned by its smallest member.

A node is a sequence of turns that conversations begin with; they are its
members, and the smallest of them owns it. Below a node that a conversation
owns it owns all of its own path, as the members of a deeper node are among
those of a shallower one: what it owns is a suffix of its path. So every node
has one owner, and what is summed over the nodes of a subtree can be summed over
the conversations that pass its top instead:

* saved tokens: each member's tokens from there on, less those of the nodes
  that it owns, which are counted once;
* children: the members that own the next node of their path;
* leaves: the members that own the last node of their path, where it is
  childless.

Turns are read as digests and word counts, and gathered by blocks of 20
conversations, so that what conversations share within a block needs no join.
Owners come from two steps, as a node may have very many members (the root has
all): the least member of each node and salt, then, by a window over the few
salts of a node, that of the node; and rows learn them by node and salt. Sums
over nodes combine before the shuffle. Members that end at a node are written
into chunks of at most CHUNK ids, which one task reads in order for the node's
digest without holding them.

Defined cases: a null role or text counts as empty; turns go by number, null
first, those of one number by the digest of role and text; repeated rows are one turn
after another; rows without conv_id are left out; a conversation is one row of
digests (16 bytes a turn), however long its texts are; an empty table has no
node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Conversations of a block, and how many lengths of shared heads there are.
BLOCK, HEADS = 20, 4
#: Member ids of a chunk at most; least number of salts.
CHUNK, SALTS = 4096, 32
#: Digest of the root, and bytes of a digest.
ROOT, DIGEST = b"", 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def block_of(conv_id: Column) -> Column:
    return conv_id - conv_id % BLOCK


def turns_of(rows: DataFrame) -> DataFrame:
    """(block, conv_id, own) of conversations (conv_id, turn, role, text): own has key (digest of role and text) and words of each turn, in order. One shuffle, by block."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    conv = F.col("conv_id").cast("long")
    t = F.struct(F.col("turn"), key.alias("key"), words.alias("words"))
    one = rows.where("conv_id is not null").select(block_of(conv).alias("block"), conv.alias("conv_id"), t.alias("t")).repartition("block")
    return one.groupBy("block", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation after the head of the first of its block. No further shuffle."""
    n = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    head = F.first(F.when(F.col("conv_id") == F.col("block"), F.slice("own", 1, HEADS - 1)), ignorenulls=True).over(Window.partitionBy("block"))
    rows = turns.select("conv_id", "own", n.alias("n"), F.coalesce(head, F.slice("own", 1, 0)).alias("head"))
    return rows.select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("n")), F.slice("own", F.col("n") + 1, F.size("own"))).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, path, words) of conversations (conv_id, turns): n turns, the digest of each prefix from the root on, and the words of each; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, words = b.column("keys").to_pylist(), b.column("words").to_pylist()
            chain = lambda before, key: hashlib.sha256(before + key).digest()[:DIGEST]
            path = [list(accumulate(k, chain, initial=ROOT)) for k in keys]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([len(k) for k in keys], pa.int64()), pa.array(path, pa.list_(pa.binary())), pa.array([list(accumulate(w, initial=0)) for w in words], pa.list_(pa.int64()))], names=["conv_id", "n", "path", "words"])

    flat = conversations.select("conv_id", F.transform("turns", lambda t: t["key"]).alias("keys"), F.transform("turns", lambda t: t["words"]).alias("words"))
    return staged(flat.mapInArrow(run, "conv_id long, n long, path array<binary>, words array<long>"), "paths")


def shares(path: DataFrame) -> DataFrame:
    """(conv_id, above, leaf) of paths(): the deepest node of the path that another conversation owns, as (depth, owner), null where there is none; and whether the last node is childless and its own."""
    salts = max(SALTS, int(path.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = path.select("conv_id", "n", F.pmod(F.xxhash64("conv_id"), F.lit(salts)).cast("int").alias("salt"), F.posexplode("path").alias("depth", "node"))
    least = rows.groupBy("node", "salt").agg(F.min("conv_id").alias("owner"), F.max("n").alias("longest"))
    whole = Window.partitionBy("node")  # at most a row for each salt
    least = least.select("node", "salt", F.min("owner").over(whole).alias("owner"), F.max("longest").over(whole).alias("longest"))
    marked = rows.join(least, ["node", "salt"])
    above = F.max(F.when(F.col("owner") < F.col("conv_id"), F.struct("depth", "owner"))).alias("above")
    return marked.groupBy("conv_id").agg(above, F.max((F.col("depth") == F.col("n")) & (F.col("longest") == F.col("n")) & (F.col("owner") == F.col("conv_id"))).alias("leaf"))


def ends_of(path: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of the members that end at a node, ascending."""
    last = path.select(F.element_at("path", -1).alias("node"), "conv_id", F.floor(F.col("conv_id") / CHUNK).alias("chunk"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    chunks = last.groupBy("node", "chunk").agg(ids.alias("ids")).repartition("node").sortWithinPartitions("node", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, hashlib.sha256()
        for b in batches:
            done = []
            for node, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if node == at:
                    digest.update(b",")
                else:
                    if at is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], names=["node", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    return chunks.mapInArrow(run, "node binary, ends_sha256 string")


def nodes_of(path: DataFrame) -> DataFrame:
    """(node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) of paths(). One row for each node."""
    rows = path.join(shares(path), "conv_id")
    rows = rows.select("conv_id", "n", "words", "leaf", F.coalesce(F.col("above.depth") + 1, F.lit(0)).alias("owned"), F.col("above.owner").alias("over"), F.posexplode("path").alias("depth", "node"))
    until = lambda d: F.get("words", F.greatest(d - 1, F.lit(0)))  # noqa: E731  words before the node of that depth
    total = F.get("words", F.col("n").cast("int"))
    occurring, own = total - until(F.col("depth")), total - until(F.greatest("depth", "owned"))
    parent = F.when(F.col("depth") > 0, F.when(F.col("owned") < F.col("depth"), F.col("conv_id")).otherwise(F.col("over")))
    child = (F.col("n") > F.col("depth")) & (F.col("owned") <= F.col("depth") + 1)
    rows = rows.select("node", "depth", F.struct("conv_id", parent.alias("parent")).alias("own"), (occurring - own).alias("saved"), child.cast("long").alias("child"), F.col("leaf").cast("long").alias("leaf"))
    out = rows.groupBy("node").agg(F.min("own").alias("own"), F.max("depth").cast("long").alias("depth"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return out.select("node", "own.conv_id", "depth", F.col("own.parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")


def trie(conversations: DataFrame) -> DataFrame:
    """nodes_of() with ends_sha256, of conversations (conv_id, turns: key and words of each turn)."""
    path = paths(conversations)
    return nodes_of(path).join(ends_of(path), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return trie(rebuilt(turns_of(table(spark, sf_dir, "conversations")))).drop("node")


OP13_SQL = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
  SELECT conv_id, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))) AS x FROM (SELECT DISTINCT conv_id FROM t)
), c AS (
  SELECT conv_id, xor(list_reduce(x, lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % {HEADS} AS h FROM bits
), r AS (
  SELECT c.conv_id, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {BLOCK} AND place <= h
  UNION ALL
  SELECT conv_id, place, role, text FROM c JOIN t USING (conv_id) WHERE place > h
), p AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY place) AS node, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM c
), n AS (
  SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY node
), pairs AS (
  SELECT DISTINCT a.node AS top, b.node, b.depth - a.depth AS below FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), kids AS (
  SELECT top AS node, count(*) AS n_children FROM pairs WHERE below = 1 GROUP BY top
), sums AS (
  SELECT top AS node, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves FROM pairs JOIN n USING (node) LEFT JOIN kids USING (node) GROUP BY top
), ends AS (
  SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM p WHERE depth = (SELECT max(depth) FROM p q WHERE q.conv_id = p.conv_id) GROUP BY node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM n JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN ends USING (node) LEFT JOIN pairs ON pairs.node = n.node AND below = 1 LEFT JOIN n up ON up.node = pairs.top"""
