"""Personal data: candidate spans, boosted trees, calibrated thresholds.

All of it is DataFrame functions and Spark's own gradient-boosted trees.

1. Base spans: the fixed pattern and check of each kind (KINDS), leftmost and
   non-overlapping; a match that fails its check is dropped.
2. Candidates: more generous patterns, several for a kind, whose spans may
   overlap base spans and one another (a card number that the base pattern ran
   together with a phone number before it, a phone number without a plus).
3. Trees: a classifier over format features (length, digits, separators,
   groups, check sums, the last label of a name) and context features (what
   touches the span, words before it) learns from all labelled candidates,
   those of equal features as one weighted row. Those that base rules confirm
   are positive.
   Those that fail their kind's check, lie on a base span of another kind or
   are part of a longer word or number, begin with a year (phones) or end
   unlike a name (addresses with [at]) are negative. The rest, which rules
   cannot tell, are judged and not learnt from. No rule knows the forms that the
   base patterns miss, so each confirmed address and phone also makes one
   example and its look-alike: the address with [at] and [dot] against the
   same words without a name's ending; the phone without its plus after a word
   that asks for one against the same digits after words that count, date or
   number something, or after none.
4. Thresholds: each half of the examples is judged by trees that learnt from
   the other; of these scores, the least at which PRECISION of a kind's examples
   are positive, if there are at least LEAST examples of either sort. Where a kind has made examples, its confirmed spans
   do not count, as they are never added. Candidates of that score or more that
   touch no base span and are no negatives are added, the best first where they overlap.

Starts and ends are code points, the end exclusive.

Defined cases: null and empty texts have no spans; repeated rows are judged
each, and alike; a table without candidates of both sorts trains nothing and
adds nothing; rows with a null doc_id are judged like others; a very long text
is searched whole, in time proportional to its length; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

KINDS = ("email", "ip", "card", "phone")
PRECISION, LEAST, TREES, DEPTH, CONTEXT = 0.95, 10, 12, 4, 24
#: The base patterns. Possessive repeats and the look-behinds keep long runs linear; they match what the plain patterns match.
BASE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9]++(?:[\x20-][0-9]++)*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
CANDIDATES = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| ?\[at\] ?| ?\(at\) ?)[A-Za-z0-9-]++(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)[A-Za-z0-9-]++)++",
    r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?)(?![0-9])",
    r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|(?<![0-9])[0-9]{2,4})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
)
#: What a text must hold for a kind's patterns to match at all.
HINT = ("@|at[\\])]", "[0-9]\\.[0-9]", "[0-9][ -]?[0-9]", "[0-9]")
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Words before a span that ask for its kind, and those that say it counts or names something else.
WORDS = (r"\b(?:e-?mail|contact|write|reach)", r"\b(?:ip|host|server|addr)", r"\b(?:card|visa|credit|pay|account)", r"\b(?:tel|phone|call|fax|mobile|ring|dial|whatsapp)")
CONTRARY = r"\b(?:order|isbn|issn|part|version|release|table|page|invoice|model|item|serial|lot|year|section|figure|article|reference|ticket|case|batch|build)\b[^.!?]*$|\b(?:in|since|until|from) (?:19|20)[0-9]{2}\W*$"
#: Words that examples are put after: of phones, and of what looks like one.
ASKING = ("call ", "phone: ", "tel. ", "fax ", "mobile ", "call me at ")
COUNTING = ("order ", "order number ", "ISBN ", "part ", "part no. ", "version ", "table ", "page ", "in 2019 ", "since 2004 ", "invoice ", "model ", "item ", "serial ", "call about order ", "phone part ", "about ", "of ", "the ", "in ", "and ", "")
#: Endings of names, besides those of two letters, and words that end none.
ENDINGS = r"(?i)\.(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev)$"
NO_ENDINGS = ("today", "there", "please", "noon", "again", "tomorrow")
SPAN = "array<struct<start:int,kind:int,end:int>>"
FOUND = "array<struct<start:int,kind:int,end:int,match:string,before:string,after:string>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), add) % 10 == 0


def passes(kind: int, x: Column) -> Column:
    """The check of a base match."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return x.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    n = F.length(digits(x))
    if kind == 2:
        return F.when((n >= 12) & (n <= 19), luhn(digits(x))).otherwise(False)
    return (n >= 9) & (n <= 15)


def located(text: Column, pattern: str, kind: int, hint: str, keep=None) -> Column:
    """The matches of a pattern that `keep` accepts, in FOUND's form: places are sums of the lengths of matches and of what parts them."""
    m, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    rows = F.arrays_zip(m.alias("m"), F.slice(gaps, 1, F.size(m)).alias("gap"), F.slice(gaps, 2, F.greatest(F.size(m), F.lit(1))).alias("next"))
    empty = F.array().cast(FOUND)

    def step(a: Column, r: Column) -> Column:
        start = a["at"] + F.length(r["gap"])
        end = start + F.length(r["m"])
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), r["m"].alias("match"), F.right(r["gap"], F.lit(CONTEXT)).alias("before"), F.left(r["next"], F.lit(1)).alias("after")))
        return F.struct(end.alias("at"), (F.concat(a["out"], one) if keep is None else F.when(keep(r["m"]), F.concat(a["out"], one)).otherwise(a["out"])).alias("out"))

    return F.when(text.rlike(hint), F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])).otherwise(empty)


def plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def row_key() -> Column:
    """Tells rows of unlike doc_id or text apart; a null doc_id is like no other."""
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))))


def extracted(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, row, base, found) of each row, one pass over the texts; and further columns."""
    text = F.coalesce("text", F.lit(""))
    base = F.concat(*(plain(located(text, BASE[k], k, HINT[k], lambda x, k=k: passes(k, x))) for k in range(4)))
    found = F.concat(*(located(text, CANDIDATES[k], k, HINT[k]) for k in range(4)))
    some = text.rlike("[0-9]|@|at[\\])]")
    return docs.select(
        "doc_id",
        row_key().alias("row"),
        F.when(some, F.array_sort(base)).otherwise(F.array().cast(SPAN)).alias("base"),
        F.when(some, found).otherwise(F.array().cast(FOUND)).alias("found"),
        *more,
    )


FEATURES = ("kind", "size", "n_digits", "n_letters", "n_seps", "n_dots", "groups", "first_digit", "luhn_ok", "octets_ok", "plus", "at", "last_label", "ending", "touch_before", "touch_after", "digit_before", "said", "contrary")
#: Kinds with made examples.
MADE = (0, 3)
EXAMPLES = "array<struct<match:string,before:string,label:double>>"


def ends_like_name(m: Column) -> Column:
    """Whether the last label of an address, [dot] read as a dot, ends names."""
    return F.regexp_replace(m, r" ?[\[(]dot[\])] ?", ".").rlike(ENDINGS)


def examples(kind: Column, m: Column, pick: Column) -> Column:
    """Of a confirmed match: a form that no base pattern knows, and its look-alike; pick: a number that chooses among forms."""
    one = lambda options, k=0: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.shiftright(pick, k), F.lit(len(options))) + 1).cast("int"))
    made = lambda text, before, label: F.struct(text.alias("match"), before.alias("before"), F.lit(label).alias("label"))
    at, dot = one((" [at] ", "(at)", " [at] ")), one((" [dot] ", "(dot)", "."))
    # Names without digits and with fewer labels too: how this table's addresses look is no mark of one.
    bit = lambda k: F.pmod(F.shiftright(pick, k), F.lit(2)) == 1
    short = F.when(bit(20), F.regexp_replace(m, "[0-9]", "")).otherwise(m)
    short = F.when(bit(21), F.regexp_replace(short, r"@[^.@]*\.(?=[^.@]+\.)", "@")).otherwise(short)
    m = F.when((kind == 0) & short.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$"), short).otherwise(m)
    hidden = F.concat(F.substring_index(m, "@", 1), at, F.regexp_replace(F.substring_index(m, "@", -1), r"\.", dot))
    unlike = F.concat(F.substring_index(m, "@", 1), at, F.regexp_replace(F.regexp_extract(F.substring_index(m, "@", -1), r"^(.*)\.[^.]*$", 1), r"\.", dot), dot, one(NO_ENDINGS, 8))
    bare, ten = F.regexp_replace(m, r"^\+[0-9]{1,3}[ .-]?", ""), F.right(digits(m), F.lit(10))
    parted = lambda style: F.regexp_replace(ten, "^(...)(...)(....)$", style)
    shapes = lambda k: F.when(F.length(ten) == 10, F.element_at(F.array(bare, *map(parted, ("$1-$2-$3", "$1 $2-$3", "$1 $2 $3", "($1) $2-$3"))), (F.pmod(F.shiftright(pick, k), F.lit(5)) + 1).cast("int"))).otherwise(bare)
    return F.when(kind == 0, F.array(made(hidden, F.lit(" "), 1.0), made(unlike, F.lit(" "), 0.0))).when(kind == 3, F.array(made(shapes(24), one(ASKING, 4), 1.0), made(shapes(32), one(COUNTING, 12), 0.0))).otherwise(F.array().cast(EXAMPLES))


def featured(rows: DataFrame) -> DataFrame:
    """One row for each candidate (form 0) and made example (form above 0): row, span, features, label (null where rules cannot tell) and on_base."""
    x = rows.select("row", "base", F.explode("found").alias("c")).select("row", "base", "c.*")
    confirmed = F.exists("base", lambda b: (b["start"] == F.col("start")) & (b["end"] == F.col("end")) & (b["kind"] == F.col("kind")))
    other = F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")) & (b["kind"] != F.col("kind")))
    sound = reduce(lambda out, k: F.when(F.col("kind") == k, passes(k, F.col("match"))).otherwise(out), range(4), F.lit(False))
    nameless = (F.col("kind") == 0) & ~F.col("match").contains("@") & ~ends_like_name(F.col("match"))
    dated = (F.col("kind") == 3) & F.col("match").rlike("^(?:19|20)[0-9]{2}[ .-]")
    inside = F.col("before").rlike("[A-Za-z0-9_][./_-]?$|[0-9][ .-]$") | F.col("after").rlike("[A-Za-z0-9_]")
    x = x.withColumn("label", F.when(confirmed, 1.0).when(~sound | other | inside | nameless | dated, 0.0))
    pick = F.xxhash64("row", "start", "end")
    forms = F.concat(F.array(F.struct("match", "before", "label")), F.when(confirmed, examples(F.col("kind"), F.col("match"), pick)).otherwise(F.array().cast(EXAMPLES)))
    x = x.select("row", "base", "start", "end", "kind", "after", F.posexplode(forms).alias("form", "x")).select("*", "x.*")
    m, n = F.col("match"), digits(F.col("match"))
    prev = F.right(F.regexp_replace("before", "\\s+$", ""), F.lit(1))
    number = lambda c: c.cast("double")
    said = reduce(lambda out, k: F.when(F.col("kind") == k, F.lower("before").rlike(WORDS[k])).otherwise(out), range(4), F.lit(False))
    return x.select(
        "row", "start", "end", "form", "label",
        number(F.col("kind")).alias("kind"), number(F.length(m)).alias("size"), number(F.length(n)).alias("n_digits"),
        number(F.length(F.regexp_replace(m, "[^A-Za-z]", ""))).alias("n_letters"), number(F.length(F.regexp_replace(m, "[^ ()-]", ""))).alias("n_seps"),
        number(F.length(F.regexp_replace(m, "[^.]", ""))).alias("n_dots"), number(F.size(F.split(m, "[^A-Za-z0-9]+"))).alias("groups"),
        F.coalesce(number(F.left(n, F.lit(1)).try_cast("int")), F.lit(-1.0)).alias("first_digit"),
        number(F.when(F.length(n).between(12, 19), luhn(n)).otherwise(False)).alias("luhn_ok"), number(m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")).alias("octets_ok"),
        number(m.startswith("+")).alias("plus"), number(m.contains("@")).alias("at"), number(F.length(F.regexp_extract(m, r"\.([A-Za-z]+)$", 1))).alias("last_label"), number(ends_like_name(m)).alias("ending"),
        number(F.right("before", F.lit(1)).rlike("[^\\s]")).alias("touch_before"), number(F.col("after").rlike("[^\\s.,;:!?]")).alias("touch_after"),
        number(prev.rlike("[0-9.+-]")).alias("digit_before"), number(said).alias("said"), number(F.lower("before").rlike(CONTRARY)).alias("contrary"),
        F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start"))).alias("on_base"),
    )


def scored(candidates: DataFrame) -> tuple[DataFrame, dict[int, float]] | None:
    """The candidates with a score each, and each kind's threshold; None where there is nothing to learn from."""
    own = candidates.where("label is not null")
    half = F.pmod(F.xxhash64("row"), F.lit(2)).alias("half")
    # What trees see of an example is its features: equal ones are one row with their number as its weight, so all of them are learnt from.
    own = staged(own.groupBy(half, (F.col("form") > 0).alias("made"), "label", *FEATURES).agg(F.count("*").cast("double").alias("n")), "pii-examples")
    ways = own.groupBy("half", "label").agg(F.count("*").alias("n")).collect()  # four rows at most
    if len(ways) < 4:
        return None
    # So many bins that Spark looks for splits among all rows, which it does up to maxBins squared.
    bins = max(32, math.isqrt(sum(r["n"] for r in ways)) + 1)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="n", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, maxBins=bins)
    fit = lambda rows: trees.fit(vectors.transform(rows).select("features", "label", "n"))
    judged = lambda model, df: model.transform(vectors.transform(df)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    kept = own.where(~(~F.col("made") & (F.col("label") == 1) & F.col("kind").isin(*MADE)))
    apart = judged(fit(own.where("half = 0")), kept.where("half = 1")).unionByName(judged(fit(own.where("half = 1")), kept.where("half = 0")))
    steps = apart.groupBy("kind", F.round("score", 3).alias("score")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("yes")).collect()  # 4 kinds, 1001 scores
    thresholds = {k: t for k in range(len(KINDS)) if (t := threshold([(r["score"], r["n"], r["yes"]) for r in steps if r["kind"] == k])) is not None}
    return (judged(fit(own), candidates.where("form = 0")), thresholds) if thresholds else None


def threshold(steps: list[tuple[float, int, float]]) -> float | None:
    """Where a kind's spans begin to be added: half way from the least score (of rows: score, examples, positive ones) down to which PRECISION of the examples are positive to the next one, 0.5 at least; None for fewer than LEAST of either sort."""
    total, positive = sum(n for _, n, _ in steps), sum(yes for _, _, yes in steps)
    if positive < LEAST or total - positive < LEAST:
        return None
    n = yes = 0
    best, down = None, sorted(steps, reverse=True)
    for k, (score, more, good) in enumerate(down):
        n, yes = n + more, yes + good
        if yes >= PRECISION * n and score >= 0.5:
            best = max(0.5, (score + (down[k + 1][0] if k + 1 < len(down) else 0.0)) / 2)
    return best


def added(rows: DataFrame) -> DataFrame | None:
    """(row, added) of the rows (row, base, found) to which the trees add spans; None where there is nothing to learn from."""
    found = scored(featured(rows.where(F.size("found") > 0)))
    if not found:
        return None
    candidates, thresholds = found
    enough = reduce(lambda a, b: a | b, ((F.col("kind") == k) & (F.col("score") >= t) for k, t in thresholds.items()))
    one = F.struct((-F.col("score")).alias("rank"), F.col("start"), F.col("kind").cast("int").alias("kind"), F.col("end"))
    kept = candidates.where(enough & ~F.col("on_base") & F.col("label").isNull()).groupBy("row").agg(F.array_sort(F.collect_set(one)).alias("more"))
    apart = lambda out, x: F.when(F.exists(out, lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"])), out).otherwise(F.concat(out, F.array(F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))))
    # Written, so that Spark knows its size: it is sent to all tasks only if that is small.
    return staged(kept.select("row", F.aggregate("more", F.array().cast(SPAN), apart).alias("added")), "pii-added")


def with_spans(rows: DataFrame, *columns: str) -> DataFrame:
    """columns of rows (row, base, found) and spans. Rows without a candidate, most of them, meet no join."""
    more, empty = added(rows), F.array().cast(SPAN)
    if more is None:
        return rows.select(*columns, F.col("base").alias("spans"))
    few = rows.where(F.size("found") > 0).join(more, "row", "left").select(*columns, F.array_sort(F.concat("base", F.coalesce("added", empty))).alias("spans"))
    return rows.where(F.size("found") == 0).select(*columns, F.col("base").alias("spans")).unionByName(few)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, spans) of each row of docs (doc_id, text); base and spans sorted by start, then kind, as in SPAN."""
    return with_spans(staged(extracted(docs), "pii-rows"), "doc_id", "row", "base")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each personal span of text replaced by its kind in brackets, n_chars (if there) as the new text's; all other columns as they are, whatever their names."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct("*").alias("all"))
    rows = with_spans(staged(extracted(own, F.col("all")), "pii-rows"), "all").select(F.col("all"), F.col("all.text").cast("string").alias("text"), "spans")
    mark = lambda k: F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), k + 1)), F.lit("]"))

    def step(a: Column, x: Column) -> Column:
        new = F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, x["start"] - a["at"]), mark(x["kind"]))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] >= a["at"], new).otherwise(a["out"]).alias("out"))

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    some = F.size("spans") > 0
    rows = rows.select("all", some.alias("some"), F.when(some, clean).otherwise(F.col("text")).alias("text"))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        old = F.col("all")[c]
        return (F.when(F.col("some"), F.length("text").cast(docs.schema[c].dataType)).otherwise(old) if c == "n_chars" else old).alias(c)

    return rows.select(*map(column, docs.columns))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, and all spans."""
    rows = personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", *map(count, range(4)), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
