"""Nucleotide views of the driver's tables: letters of prose become bases, everything else a break."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reference import reference_from_records

LETTERS = string.ascii_lowercase + string.ascii_uppercase + " "
BASES = "".join("ACGT"[(i % 26) % 4] for i in range(52)) + "A"

#: Patterns beside those cut from the reference: palindromes, short ones and some that hit nothing.
EXTRA_PATTERNS = ("ACGT", "AATT", "GGATCC", "ACGTACGT", "TTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTT", "CCCCCCCCCCCCCCCC", "gattaca")


def encode(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, LETTERS, BASES), "[^ACGT]", "N")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select(F.col("item_id").alias("seq_order"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("name"), F.lit("").alias("description"), encode(F.col("text")).alias("sequence"))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_from_records(records(spark, sf_dir), check=False)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").cast("string").alias("query_id"), encode(F.col("text")).alias("sequence"))


def patterns(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = EXTRA_PATTERNS) -> DataFrame:
    """Every 24 bases of the reference's records, without repeats, and the extra patterns; a pattern is its own id."""
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length("sequence") - 24, F.lit(0)), F.lit(24)), lambda i: F.substring("sequence", i + 1, F.lit(24)))
    p = records(spark, sf_dir).select(F.explode(cut).alias("pattern")).where("length(pattern) = 24 AND pattern NOT LIKE '%N%'").distinct()
    if extra:
        p = p.unionByName(spark.createDataFrame([(x,) for x in extra], "pattern string"))
    return p.select(F.col("pattern").alias("query_id"), "pattern")


def repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows like a benchmark's raw repetitions, from ``lineitem``."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    status = F.when(F.col("l_discount") > 0.085, "failed").when(F.col("l_tax") > 0.075, "not_applicable").otherwise("ok")
    return x.select(
        F.col("l_returnflag").alias("dataset"),
        F.col("l_linestatus").alias("method"),
        F.concat(F.lit("op"), F.pmod("l_linenumber", F.lit(3)).cast("string")).alias("operation"),
        F.pmod("l_orderkey", F.lit(5)).alias("repetition"),
        (F.col("l_extendedprice") / 10000).alias("seconds"),
        F.col("l_quantity").cast("long").alias("query_count"),
        F.col("l_partkey").alias("query_bases"),
        F.pmod("l_suppkey", F.lit(2)).alias("checksum"),
        F.col("l_orderkey").alias("total_hits"),
        status.alias("status"),
    )
