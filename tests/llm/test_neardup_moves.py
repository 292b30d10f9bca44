"""Near duplicates move few texts: those of documents that are compared or decided on."""

from pyspark.sql import functions as F

from tidewright.llm import neardup
from tidewright.llm.common import met_by


def written_to_shuffles(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_without_copies_stay_where_they_are(spark):
    """2,000 texts of 16,000 bytes, which no coding shortens to less than half; ten have a copy."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(480)), lambda i: F.md5(F.concat_ws("-", F.col("id") % 2000, i))), " ")
        docs = spark.range(2010).select(F.col("id").alias("doc_id"), words.alias("text")).localCheckpoint()
        before = written_to_shuffles(spark)
        kept = neardup.deduplicated(docs).select("doc_id", F.length("text").alias("n")).collect()
        moved = written_to_shuffles(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r["doc_id"] for r in kept) == list(range(2000))
    assert moved < 10e6, moved  # sketches are moved several times; the texts alone are 32 MB


def test_met_by_loses_no_key(spark):
    """Every row that has a key is met; few others are; without keys none is."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 4 > 0, F.col("id")).alias("a"), F.md5(F.col("id").cast("string")).alias("b"))
    keys = rows.where("a % 5 = 1")
    got = met_by(rows, keys, ("a", "b"))
    n = keys.count()
    assert got.columns == ["a", "b", "__met"] and got.count() == 40_000 and got.where("__met").join(keys, ["a", "b"], "left_semi").count() == n
    assert got.where("__met").count() < n + 0.08 * 40_000
    assert met_by(rows, keys.limit(0), ("a", "b")).where("__met").count() == 0
