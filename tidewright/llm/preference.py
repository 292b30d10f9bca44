"""Preference formatting of chosen and rejected conversations.

DataFrame functions alone. Both sides of a pair are gathered by one grouping on
the pair's id; the first place where their turns differ ends the longest common
turn prefix. Only then are turns rendered, the common ones once, as the prompt,
and the others as two completions. Masks are the spans of a completion (code
points, end exclusive) whose tokens count for the loss: the words of TRAINED
roles with the mark that ends a turn.

A rendered conversation is one row; turns are gathered by conversation and
never by what conversations share, so a first turn or a whole conversation
that very many have is no large group.

Defined cases: a null role or text counts as empty; turns go by number, ties
by role and text, and equal rows are one turn after another; marks inside a
role or text are escaped, so unlike turns are never rendered alike; a
conversation without a partner makes no pair; equal conversations have the
whole as prompt and empty completions; a turn without a number or a
conversation without an id is left out; a very long text is rendered whole; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A turn's rendering: OPEN role CLOSE text END; "|" of a role is doubled, and "<|" of a text becomes "<||".
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = ("assistant",)


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, t: turn, role, text) of the rows that have both numbers."""
    t = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.where("conv_id is not null and turn is not null").select("conv_id", t.alias("t"))


def shown(part: Column) -> Column:
    """The turns of an array, with their renderings."""
    role, text = (lambda t: F.replace(t["role"], F.lit("|"), F.lit("||"))), (lambda t: F.replace(t["text"], F.lit("<|"), F.lit("<||")))
    return F.transform(part, lambda t: F.struct(t["role"].alias("role"), F.length(role(t)).alias("n_role"), F.concat(F.lit(OPEN), role(t), F.lit(CLOSE), text(t), F.lit(END)).alias("shown")))


def _whole(part: Column) -> Column:
    return F.array_join(F.transform(part, lambda t: t["shown"]), "")


def _mask(part: Column) -> Column:
    """Spans of the trained turns of a completion."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        end = a["at"] + F.length(t["shown"])
        span = F.array(F.struct((a["at"] + t["n_role"] + len(OPEN + CLOSE)).alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"].isin(*TRAINED), F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    return F.aggregate(part, zero, step, lambda a: a["out"])


def formatted(pairs: DataFrame) -> DataFrame:
    """preference_pairs() of conversations (conv_id, a, b): arrays of turns in order. No shuffle."""
    n = F.least(F.size("a"), F.size("b"))
    unlike = F.zip_with(F.slice("a", 1, n), F.slice("b", 1, n), lambda x, y: (x["role"] != y["role"]) | (x["text"] != y["text"]))
    rows = pairs.select("conv_id", "a", "b", n.alias("n"), F.array_position(unlike, True).alias("first"))
    rows = rows.select("conv_id", "a", "b", F.when(F.col("first") > 0, F.col("first") - 1).otherwise(F.col("n")).cast("int").alias("n_prefix"))
    after = lambda x: F.slice(x, F.col("n_prefix") + 1, F.greatest(F.size(x) - F.col("n_prefix"), F.lit(0)))
    rows = rows.select("conv_id", "n_prefix", shown(F.slice("a", 1, F.col("n_prefix"))).alias("p"), shown(after("a")).alias("a"), shown(after("b")).alias("b"))
    return rows.select("conv_id", F.col("n_prefix").cast("long").alias("n_prefix"), _whole(F.col("p")).alias("prompt"), _whole(F.col("a")).alias("chosen"), _whole(F.col("b")).alias("rejected"), _mask(F.col("a")).alias("chosen_mask"), _mask(F.col("b")).alias("rejected_mask"))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(conv_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask) of conversations with one conv_id in both tables (conv_id, turn, role, text). One shuffle."""
    both = turns_of(chosen).withColumn("first", F.lit(True)).unionByName(turns_of(rejected).withColumn("first", F.lit(False)))
    side = lambda x: F.array_sort(F.collect_list(F.when(x, F.col("t"))))
    pairs = both.groupBy("conv_id").agg(side(F.col("first")).alias("a"), side(~F.col("first")).alias("b"))
    return formatted(pairs.where((F.size("a") > 0) & (F.size("b") > 0)))


def cut_short(turns: DataFrame) -> DataFrame:
    """(conv_id, a, b): each conversation of turns, and as b the same with the last assistant turn cut to its first half. One shuffle."""
    rows = turns_of(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("a"), F.max(F.when(F.col("t.role") == "assistant", F.col("t.turn"))).alias("last"))
    half = lambda t: F.substring(t["text"], F.lit(1), F.floor(F.length(t["text"]) / 2).cast("int"))
    cut = lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when((t["turn"] == F.col("last")) & (t["role"] == "assistant"), half(t)).otherwise(t["text"]).alias("text"))
    return rows.select("conv_id", "a", F.array_sort(F.transform("a", cut)).alias("b"))


def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with its last answer cut short, formatted as a preference pair."""
    rows = formatted(cut_short(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias(c)
    return rows.select("conv_id", "n_prefix", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


OP4_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), last AS (
  SELECT conv_id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id
), side AS (
  SELECT 'a' AS side, conv_id, turn, role, text FROM t
  UNION ALL
  SELECT 'b', conv_id, turn, role, CASE WHEN turn = last AND role = 'assistant' THEN substr(text, 1, CAST(floor(length(text) / 2) AS BIGINT)) ELSE text END FROM t LEFT JOIN last USING (conv_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY side, conv_id ORDER BY turn, role, text) - 1 AS place, '<|' || replace(role, '|', '||') || '|>' || chr(10) || replace(text, '<|', '<||') || '<|end|>' || chr(10) AS shown FROM side
), met AS (
  SELECT a.conv_id, coalesce(min(CASE WHEN a.shown <> b.shown THEN a.place END), max(a.place) + 1) AS n_prefix
  FROM placed a JOIN placed b ON a.conv_id = b.conv_id AND a.place = b.place AND a.side = 'a' AND b.side = 'b' GROUP BY a.conv_id
), rows AS (
  SELECT p.*, n_prefix, length(shown) AS n, sum(CASE WHEN place >= n_prefix THEN length(shown) ELSE 0 END) OVER (PARTITION BY side, conv_id ORDER BY place) AS ends FROM placed p JOIN met USING (conv_id)
)
SELECT conv_id, CAST(max(n_prefix) AS BIGINT) AS n_prefix,
  coalesce(string_agg(shown, '' ORDER BY place) FILTER (WHERE side = 'a' AND place < n_prefix), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY place) FILTER (WHERE side = 'a' AND place >= n_prefix), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY place) FILTER (WHERE side = 'b' AND place >= n_prefix), '') AS rejected,
  coalesce(string_agg(CAST(ends - n + length(replace(role, '|', '||')) + 5 AS VARCHAR) || ':' || CAST(ends AS VARCHAR), ',' ORDER BY place) FILTER (WHERE side = 'a' AND place >= n_prefix AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(ends - n + length(replace(role, '|', '||')) + 5 AS VARCHAR) || ':' || CAST(ends AS VARCHAR), ',' ORDER BY place) FILTER (WHERE side = 'b' AND place >= n_prefix AND role = 'assistant'), '') AS rejected_mask
FROM rows GROUP BY conv_id"""
