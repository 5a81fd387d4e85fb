"""Queries ``opN_<name>`` and ``pipeline``: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import chat, language, licenses, mixing, near_dedup, packing, quality_model, quality_rules, token_counts, topk
from .common import crc_mod, table, write_table
from .oracles import ORACLES


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version.

    Three batches: all documents are inserted; toxic ones are deleted; clean ones of label 0 are revised (runs of blanks and
    symbols cut). The first batch is sent twice and counts once. Each text, and its revision where that differs, is
    counted where it is read; labels meet ids and counts only.
    """
    symbols = r"[#*$%&|<>!]+"
    docs = table(spark, sf_dir, "documents")
    differs = F.coalesce(F.col("text").rlike(symbols), F.lit(False))
    texts = {"n_tokens": F.col("text"), "new_n_tokens": F.when(differs, F.regexp_replace("text", symbols, ""))}
    counted = token_counts.count_tokens(docs, [F.col("doc_id"), F.col("source"), F.col("lang"), differs.alias("differs")], texts)
    counted = write_table(counted.withColumn("new_n_tokens", F.expr("if(differs, new_n_tokens, n_tokens)")), "token_counts")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min("quality").alias("quality"))
    marked = counted.join(labels.where("toxic = 1 OR quality = 0"), "doc_id")
    toxic = marked.where("toxic = 1").withColumn("op", F.lit("delete"))
    revised = marked.where("quality = 0 AND toxic <> 1").select("source", "lang", F.col("n_tokens").alias("old_n_tokens"), F.col("new_n_tokens").alias("n_tokens"), F.lit("revise").alias("op"))
    rollup = token_counts.TokenRollup(spark)
    first = counted.withColumn("op", F.lit("insert"))
    for batch, changes in (("insert", first), ("delete-toxic", toxic), ("revise-junk", revised), ("insert", first)):
        if not rollup.committed(batch):
            rollup.apply(batch, token_counts.token_deltas(token_counts.signed(changes)))
    return rollup.totals()


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources to equal weight at the size of the input; every copy of a document is a row, in shuffled order."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.source_rates(docs, None))


def op3_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    samples = language.language_sample(docs.where(~held_out).select("lang", "text"))
    return language.predict_language(docs, samples, [F.col("doc_id"), held_out.alias("held_out")])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    rows = write_table(quality_model.document_statistics(table(spark, sf_dir, "documents"), [F.col("doc_id")]), "statistics")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality_model.fit(rows.where(~held_out).join(labels, "doc_id"))
    scored = quality_model.score(rows, model, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_rollup, op2_source_mix, op3_cost_packing, op4_chat_collapse, op5_threshold_topk, op6_near_duplicates, op7_language_id, op8_quality_rules, op9_license_scan, op10_quality_classifier, pipeline)}


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
