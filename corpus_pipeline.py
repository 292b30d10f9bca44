"""A training corpus from raw documents: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; run() writes each stage's rows as Parquet to the shared folder and reads
them back for the next. All but the last return the columns of documents.

Defined cases are those of the operators: rows with a null or letterless text
go in the first stage (if no row outside the held-out third has a lang, these
alone); of repeated rows and of rows of one doc_id and text one stays; rows
without a doc_id come after all others, and go where they repeat another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, langid, neardup, packing, pii
from tidewright.llm.common import staged, table

#: Least share of a text's letters in one language.
LANGUAGE_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of which one language has half the letters or more."""
    return langid.of_one_language(docs, langid.train(docs.where(~langid.held_out())), LANGUAGE_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return neardup.deduplicated(docs).select(*docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal spans by their kind."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; a row for each piece, with its token ids."""
    return packing.pack_documents(docs, keep_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("contamination", contamination), ("personal_data", personal_data), ("packing", packed)]

#: The stages hold a trained classifier, similarity joins and a tokenizer: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
