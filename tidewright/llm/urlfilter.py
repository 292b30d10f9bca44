"""URL filters: longest-match host and path rules, then a weighted vocabulary.

Aho-Corasick finds all terms in the lower-cased url, its escapes of ASCII
characters decoded, in one pass; a hit counts if no letter or digit touches it
on either side. One strict term blocks the url, and so do SOFT_HITS different
soft terms or more whose weights sum to SOFT_WEIGHT or more. A rule that fits
decides alone. The vocabulary is a parameter and may come from a table.

Defined cases: a null url, or one without `://`, has an empty host and path,
fits no rule and is judged by its terms (none in a null); of rules that fit,
the longest wins; an escape is decoded once, and others than those of ASCII
characters stay as they are; host and path are never decoded; a very long url
is searched whole; repeated rows are judged row by row; an empty table gives an
empty result. In a table of terms, rows without a term are left out, a term
given twice has its greater weight and is strict if one row says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, table


@dataclass(frozen=True)
class Vocabulary:
    """Strict terms, and soft terms with their weights; lower-cased in A-Z."""

    strict: tuple[str, ...]
    soft: tuple[tuple[str, float], ...]

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for t in self.strict:
            a.add_word(t, (True, t))
        for t, _ in self.soft:
            a.add_word(t, (False, t))
        a.make_automaton()
        return a


#: Terms that a vocabulary from a table may hold: it is sent to every task.
MOST_TERMS = 1_000_000
DEFAULT = Vocabulary(
    ("porn", "xxx", "hentai", "escort", "casino", "viagra", "warez", "phishing"),
    (("adult", 1.0), ("sex", 1.0), ("bet", 1.0), ("poker", 1.0), ("free", 0.5), ("download", 0.5), ("crack", 1.0), ("pills", 1.0), ("loan", 0.5), ("nude", 1.0), ("dating", 1.0), ("jackpot", 1.0)),
)
SOFT_HITS, SOFT_WEIGHT = 2, 1.5
#: (rule, verdict): host, then the beginning of the path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
WORD = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
ESCAPE = re.compile(rb"%([2-6][0-9A-Fa-f]|7[0-9A-Ea-e])")


def vocabulary_of(terms: DataFrame) -> Vocabulary:
    """The vocabulary of a table (term, strict, weight) of at most MOST_TERMS terms; a null strict is false, a null weight 1."""
    term = F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = terms.where("term <> ''").groupBy(term.alias("term")).agg(F.max(F.coalesce("strict", F.lit(False))).alias("strict"), F.max(F.coalesce(F.col("weight").cast("double"), F.lit(1.0))).alias("weight"))
    found = sorted(map(tuple, rows.limit(MOST_TERMS + 1).collect()))
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return Vocabulary(tuple(t for t, strict, _ in found if strict), tuple((t, w) for t, strict, w in found if not strict))


def searched(url: str) -> str:
    """The text in which terms are sought."""
    raw = url.encode(errors="replace")
    if b"%" in raw:
        raw = ESCAPE.sub(lambda m: bytes([int(m[1], 16)]), raw)
    return raw.translate(LOWER).decode()


def hits(url: str, a: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """The strict and the soft terms that stand in a url as words."""
    low = searched(url)
    found: dict[bool, set[str]] = {True: set(), False: set()}
    touches = lambda i: 0 <= i < len(low) and ord(low[i]) in WORD
    if len(a):
        for end, (strict, term) in a.iter(low):
            if not touches(end + 1) and not touches(end - len(term)):
                found[strict].add(term)
    return found[True], found[False]


def by_rule(host, path, rules: tuple[tuple[str, str], ...] = RULES):
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest ends outermost
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        out = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(rule)).otherwise(out)
    return out


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, vocabulary: Vocabulary = DEFAULT, soft_hits: int = SOFT_HITS, soft_weight: float = SOFT_WEIGHT) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight) of every row of pages (page_id, url). No shuffle."""
    kind = pages.schema["page_id"].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, weight = shared.value.automaton(), dict(shared.value.soft)
        for b in batches:
            found = [hits(u or "", automaton) for u in b.column("url").to_pylist()]
            terms = [pa.array([sorted(x[i]) for x in found], pa.list_(pa.string())) for i in (0, 1)]
            weights = pa.array([sum(weight[t] for t in sorted(x[1])) for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *terms, weights], names=["page_id", "url", "strict_hits", "soft_hits", "soft_weight"])

    rows = pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, url string, strict_hits array<string>, soft_hits array<string>, soft_weight double")
    url = F.coalesce("url", F.lit(""))
    has = F.instr(url, "://") > 0
    rest = F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")
    host = F.when(has, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")
    path = F.when(has, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "strict_hits", "soft_hits", "soft_weight")
    rows = rows.withColumn("rule", by_rule(F.col("host"), F.col("path"), rules))
    blocks = [r for r, v in rules if v == "block"]
    method = (F.size("strict_hits") > 0) | ((F.size("soft_hits") >= soft_hits) & (F.col("soft_weight") >= soft_weight))
    verdict = F.when(F.col("rule").isNotNull(), F.when(F.col("rule").isin(blocks), "block").otherwise("allow")).otherwise(F.when(method, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "strict_hits", "soft_hits", "soft_weight")


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    rows = judged(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "host", "path", "rule", "verdict", F.size("strict_hits").alias("n_strict"), F.size("soft_hits").alias("n_soft"), "soft_weight")


def _sql() -> str:
    code = "16 * (strpos('0123456789abcdef', x[1:1]) - 1) + strpos('0123456789abcdef', x[2:2]) - 1"
    part = f"CASE WHEN regexp_matches(x, '^([2-6][0-9a-f]|7[0-9a-e])') THEN lower(chr(CAST({code} AS INTEGER))) || substr(x, 3) ELSE '%' || x END"
    count = lambda terms: " + ".join(f"{w} * CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)" for t, w in terms)
    ones = lambda terms: [(t, 1) for t in terms]
    when = " ".join(f"WHEN (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '{r[r.index('/') :]}') THEN '{r}'" for r, _ in sorted(RULES, key=lambda r: -len(r[0])))
    blocks = ", ".join(f"'{r}'" for r, v in RULES if v == "block")
    return f"""
WITH cut AS (
  SELECT page_id, string_split(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '%') AS parts,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, parts[1] || array_to_string(list_transform(parts[2:], lambda x: {part}), '') AS low,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE {when} ELSE NULL END AS rule, {count(ones(DEFAULT.strict))} AS n_strict, {count(ones(t for t, _ in DEFAULT.soft))} AS n_soft, CAST({count(DEFAULT.soft)} AS DOUBLE) AS soft_weight FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ({blocks}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN n_strict > 0 OR (n_soft >= {SOFT_HITS} AND soft_weight >= {SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END AS verdict,
       n_strict, n_soft, soft_weight
FROM ruled"""


OP8_SQL = _sql()
