"""Benchmark analytics over raw repetitions: summaries, speed-ups, percentiles, gates and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def constant_or_null(column: str) -> Column:
    """The one value of a group, null if there are several."""
    return F.when(F.count_distinct(F.col(column)) == 1, F.min(column))


def summarise(raw: DataFrame, keys: list[str], seconds: str = "seconds", queries: str = "query_count", bases: str = "query_bases") -> DataFrame:
    """Repetitions, median, least and most seconds of each group, and what follows: queries a second, ns a query, bases a second."""
    s = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("repetitions"), F.median(seconds).alias("median_seconds"), F.min(seconds).alias("min_seconds"), F.max(seconds).alias("max_seconds"), F.max(queries).cast("long").alias("query_count"), F.max(bases).cast("long").alias("query_bases"))
    some = F.col("median_seconds") > 0
    return s.withColumn("qps", F.when(some, F.col("query_count") / F.col("median_seconds"))).withColumn("ns_per_query", F.when(F.col("query_count") > 0, F.col("median_seconds") * 1e9 / F.col("query_count"))).withColumn("bases_per_second", F.when(some, F.col("query_bases") / F.col("median_seconds")))


def speedup(summary: DataFrame, identity: list[str], method: str, baseline: str) -> DataFrame:
    """``speedup``: the baseline method's median seconds of the same identity over the row's own; null without a baseline."""
    base = summary.where(F.col(method) == baseline).select(*identity, F.col("median_seconds").alias("baseline_seconds"))
    return summary.join(base, identity, "left").withColumn("speedup", F.when(F.col("median_seconds") > 0, F.col("baseline_seconds") / F.col("median_seconds")))


def nearest_rank(values: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles: the value at rank ceil(p * n / 100), exact, by one sort within groups."""
    aggs = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").alias(f"p{p}") for p in percents]
    return values.groupBy(*keys).agg(*aggs)


def gate_equality(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Groups whose rows (methods) disagree in any of the columns; none if all is well."""
    distinct = [F.count_distinct(F.col(c)) for c in columns]
    return rows.groupBy(*keys).agg(*[d.alias(f"distinct_{c}") for d, c in zip(distinct, columns, strict=True)]).where(reduce(lambda a, b: a | b, [F.col(f"distinct_{c}") > 1 for c in columns]))


def hit_bucket(hits: Column) -> Column:
    """Fixed names of the five ranges of hit counts."""
    return F.when(hits == 0, "user_hit_0").when(hits == 1, "user_hit_1").when(hits <= 10, "user_hit_2_10").when(hits <= 1000, "user_hit_11_1000").otherwise("user_hit_gt_1000")


def split_high_frequency(counts: DataFrame, limit: int = 100_000) -> DataFrame:
    """Queries with ``status``: skipped_high_frequency above the limit, else ok."""
    return counts.withColumn("status", F.when(F.col("total_hits") > limit, "skipped_high_frequency").otherwise("ok"))


def headline(raw: DataFrame, keys: list[str], constants: list[str], seconds: str = "seconds") -> DataFrame:
    """Rows of status ok by group: repetitions, median seconds, and each constant or null."""
    return raw.where("status = 'ok'").groupBy(*keys).agg(F.count(F.lit(1)).alias("repetitions"), F.median(seconds).alias("median_seconds"), *[constant_or_null(c).alias(c) for c in constants])


def detail(raw: DataFrame, levels: list[list[str]], seconds: str = "seconds") -> DataFrame:
    """One table of several groupings, a level each."""
    every = list(dict.fromkeys(k for level in levels for k in level))
    parts = [raw.groupBy(*level).agg(F.count(F.lit(1)).alias("repetitions"), F.median(seconds).alias("median_seconds")).withColumn("level", F.lit(i)) for i, level in enumerate(levels)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select("level", *every, "repetitions", "median_seconds")


def correctness(raw: DataFrame, keys: list[str], checksum: str, expected: tuple[str, ...] = ("ok", "not_applicable", "skipped_high_frequency")) -> DataFrame:
    """Rows, unexpected statuses, and whether repetitions agree, by group."""
    return raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("status").isin(*expected)).alias("unexpected"), (F.count_distinct(F.when(F.col("status") == "ok", F.col(checksum))) <= 1).alias("deterministic"))


def union_by_name(tables: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def audit_missing(observed: DataFrame, expected: list[DataFrame]) -> DataFrame:
    """Combinations of the expected values (a small table for each column) that were not observed."""
    combos = reduce(lambda a, b: a.crossJoin(b), expected)  # stated options of a benchmark, not data
    return combos.join(observed.select(*combos.columns).distinct(), combos.columns, "left_anti")


def environment(rows: DataFrame) -> DataFrame:
    """(key, value): distinct values of each key, joined by " | "."""
    return rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("value")), " | ").alias("value"))
