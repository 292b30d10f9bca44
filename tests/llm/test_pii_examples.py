"""Trees and thresholds of personal data learn from every labelled candidate."""

from pyspark.sql import functions as F

from tidewright.llm import pii


def test_all_labelled_candidates_count(spark):
    """30,000 addresses of hosts beside as few cards as a threshold needs: a part of them would be too few."""
    few = 2 * pii.LEAST
    rows = spark.range(30_000 + few).select(F.md5(F.col("id").cast("string")).alias("row"), F.col("id").cast("int").alias("start"), (F.col("id") + 9).cast("int").alias("end"), F.lit(0).alias("form"), (F.col("id") % 2).cast("double").alias("label"), (F.col("id") < few).alias("card"))
    values = {c: F.lit(0.0) for c in pii.FEATURES} | {"kind": F.when(F.col("card"), 2.0).otherwise(1.0), "size": (F.col("start") % 7).cast("double"), "luhn_ok": F.when(F.col("card"), F.col("label")).otherwise(0.0), "octets_ok": F.when(F.col("card"), 0.0).otherwise(F.col("label"))}
    candidates = rows.select("row", "start", "end", "form", "label", *(v.alias(c) for c, v in values.items()), F.lit(False).alias("on_base"))
    judged, thresholds = pii.scored(candidates)
    assert set(thresholds) == {1, 2} and judged.count() == 30_000 + few
    assert judged.where((F.col("score") >= 0.5) != (F.col("label") == 1)).count() == 0
