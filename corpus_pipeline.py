"""Training corpus from raw documents: classify, filter, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import mixing, near_dedup, packing, quality_model, quality_rules
from helixframe.llm.common import crc_mod, table, write_table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.5 or more). It learns from labelled rows outside the held-out fold.

    Labels meet statistics, never texts. A null or empty text is scored like any other; an empty table, or one without labels, keeps all.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = quality_model.document_statistics(docs.where(crc_mod(F.col("doc_id"), 3) != 1), [F.col("doc_id")])
    model = quality_model.fit(rows.join(labels.where("label IN (0, 1)"), "doc_id"))
    row = F.struct("*").alias("row")
    return quality_model.score_documents(docs, model, [row]).where("score >= 0.5").select("row.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; short ones stay, as shortness alone is no fault, those without a word go."""
    return quality_rules.reject_rules(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (shingles of five words, similarity 0.8 or more); texts without words stay."""
    return near_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources to equal weight, at the size of the input; null is a source, an empty table stays empty."""
    return mixing.mix(docs, mixing.source_rates(docs, None)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens; a null text gives its end id alone."""
    return packing.pack(docs)


STAGES = [("quality classifier", classify), ("quality rules", rules), ("near-duplicates", deduplicate), ("source mixing", mix), ("packing", pack)]

#: Packing needs a tokenizer and near-duplicates a fixpoint; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = write_table(docs, name)
    return docs
