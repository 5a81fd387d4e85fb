"""Maximal matches as windows over one relation of seeds.

Seeds are equal words of ``min_length`` bases in query and reference. On one diagonal (reference place less query place) a
run of seeds is one maximal exact match. Uniqueness and containment are windows over these matches, so nothing else looks
at the sequences again. Matches never cross N, contig ends or query breaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError, require
from ..functions.dna import STRANDS
from ..session import cut
from .kmers import strand_expand, words

ALGORITHMS = ("auto", "baseline", "lcp", "child", "suffix-link", "full")
#: Bases up to which the reference's words are broadcast (about 60 bytes each).
BROADCAST_BASES = 200_000
#: Bases of a query whose supermaximal starts are joined with the matches over them at a time.
STRETCH = 1024
COLUMNS = ["query_id", "sequence_id", "reference_position", "query_position", "length", "strand"]


def _check(min_length: int, strands: str, algorithm: str) -> None:
    require(min_length > 0, "min_length must be greater than 0")
    require(strands in STRANDS, f"unknown strand {strands!r}")
    if algorithm not in ALGORITHMS:
        raise EngineError("unsupported_backend", f"unknown algorithm {algorithm!r}")


def seeds(reference: DataFrame, queries: DataFrame, word: int, strands: str = "forward", broadcast_bases: int = BROADCAST_BASES) -> DataFrame:
    """query_id, strand, query_length, qpos, sequence_id, rpos of all equal words of query and reference."""
    q = strand_expand(queries.select("query_id", "sequence"), strands).withColumn("query_length", F.length("sequence").cast("long"))
    q = words(q.repartition("query_id"), ["query_id", "strand", "query_length"], "sequence", word).withColumnRenamed("pos", "qpos")
    r = words(reference.select("sequence_id", "sequence"), ["sequence_id"], "sequence", word).withColumnRenamed("pos", "rpos")
    if (reference.agg(F.sum("length")).first()[0] or 0) <= broadcast_bases:
        r = F.broadcast(r)
    return q.join(r, "word").drop("word")


def _islands(s: DataFrame, word: int, min_length: int) -> DataFrame:
    diagonal = ["query_id", "strand", "query_length", "sequence_id", "diagonal"]
    s = s.withColumn("diagonal", F.col("rpos") - F.col("qpos"))
    run = F.col("qpos") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("qpos"))
    m = s.withColumn("run", run).groupBy(*diagonal, "run").agg(F.min("qpos").alias("q"), F.count(F.lit(1)).alias("n"))
    m = m.withColumn("length", F.col("n") + (word - 1)).where(F.col("length") >= min_length)
    return m.select("query_id", "strand", "query_length", "sequence_id", "q", (F.col("q") + F.col("diagonal")).alias("r"), "length", (F.col("q") + F.col("length")).alias("e"))


def _public(m: DataFrame, *more: str) -> DataFrame:
    """Query places of the reverse strand refer to the query as given."""
    place = F.when(F.col("strand") == "-", F.col("query_length") - F.col("e")).otherwise(F.col("q"))
    return m.select("query_id", "sequence_id", F.col("r").alias("reference_position"), place.alias("query_position"), "length", "strand", *more)


def _matches(reference: DataFrame, queries: DataFrame, min_length: int, strands: str, algorithm: str, word: int | None = None, broadcast_bases: int = BROADCAST_BASES) -> DataFrame:
    _check(min_length, strands, algorithm)
    word = word or min_length
    return _islands(seeds(reference, queries, word, strands, broadcast_bases), word, min_length)


def mem(reference: DataFrame, queries: DataFrame, min_length: int = 20, strands: str = "forward", algorithm: str = "auto", skip: int | None = None, broadcast_bases: int = BROADCAST_BASES) -> DataFrame:
    """All exact matches of ``min_length`` bases or more that can be extended on neither side.

    ``skip`` asks for shorter seeds (each step saves a base, 8 at least); the result is the same.
    """
    require(skip is None or skip > 0, "skip must be greater than 0")
    word = None if skip in (None, 1) else max(min(8, min_length), min_length - skip + 1)
    return _public(_matches(reference, queries, min_length, strands, algorithm, word, broadcast_bases))


def right_maximal(reference: DataFrame, queries: DataFrame, min_length: int = 20, strands: str = "forward", algorithm: str = "auto", sampling_rate: int = 1) -> DataFrame:
    """Right-maximal matches. Callers may rely on maximality to the right alone; left-extensible ones are not given either."""
    require(sampling_rate >= 1, "sampling rate must be 1 at least")
    require(min_length >= sampling_rate, "min_length must not be below the sampling rate")
    return mem(reference, queries, min_length, strands, algorithm)


def _unique(m: DataFrame) -> DataFrame:
    """Flags: ``in_reference``, the query interval is contained in no other match's of its query and strand; ``in_query``, the same of reference intervals."""
    by_q = Window.partitionBy("query_id", "strand")
    by_r = Window.partitionBy("query_id", "strand", "sequence_id")
    e, re = F.col("e"), F.col("r") + F.col("length")
    q_before = F.max(e).over(by_q.orderBy("q", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1))
    q_same = F.count(F.lit(1)).over(Window.partitionBy("query_id", "strand", "q", "e"))
    r_before = F.max("re").over(by_r.orderBy("r", F.desc("re")).rowsBetween(Window.unboundedPreceding, -1))
    r_same = F.count(F.lit(1)).over(Window.partitionBy("query_id", "strand", "sequence_id", "r", "re"))
    m = m.withColumn("re", re).withColumn("q_before", q_before).withColumn("q_same", q_same).withColumn("r_before", r_before).withColumn("r_same", r_same)
    alone = lambda before, same, end: (F.col(before).isNull() | (F.col(before) < F.col(end))) & (F.col(same) == 1)
    return m.withColumn("in_reference", alone("q_before", "q_same", "e")).withColumn("in_query", alone("r_before", "r_same", "re"))


def _complete(sampling_rate: int, what: str) -> None:
    if sampling_rate != 1:
        raise EngineError("unsupported_backend", f"{what} needs a complete index")


def mam(reference: DataFrame, queries: DataFrame, min_length: int = 20, strands: str = "forward", algorithm: str = "auto", sampling_rate: int = 1) -> DataFrame:
    """Maximal matches whose string occurs once in the whole reference."""
    _complete(sampling_rate, "mam")
    return _public(_unique(_matches(reference, queries, min_length, strands, algorithm)).where("in_reference"))


def mum(reference: DataFrame, queries: DataFrame, min_length: int = 20, strands: str = "forward", algorithm: str = "auto", sampling_rate: int = 1) -> DataFrame:
    """Maximal matches whose string occurs once in the reference and once in its query and orientation."""
    _complete(sampling_rate, "mum")
    return _public(_unique(_matches(reference, queries, min_length, strands, algorithm)).where("in_reference AND in_query"))


def smem(reference: DataFrame, queries: DataFrame, min_length: int = 20, min_occurrences: int = 1, strands: str = "forward", algorithm: str = "auto", sampling_rate: int = 1) -> DataFrame:
    """Query intervals of ``min_length`` bases or more that occur ``min_occurrences`` times and lie in no longer such interval; a row an occurrence.

    For each start the furthest end with enough occurrences is the c-th largest end of matches that begin no later. It is
    carried as c running maxima, each fed with what the one before it displaces, all in one window order.
    """
    _complete(sampling_rate, "smem")
    require(min_occurrences > 0, "min_occurrences must be greater than 0")
    m = cut(_matches(reference, queries, min_length, strands, algorithm), "smem-matches")  # used twice; its seeds are joined once
    by = Window.partitionBy("query_id", "strand").orderBy("q", "e", "sequence_id", "r")
    so_far, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    d = m.withColumn("v", F.col("e"))
    for _ in range(min_occurrences - 1):
        d = d.withColumn("top", F.max("v").over(before)).withColumn("v", F.least(F.when(F.col("top").isNotNull(), F.col("v")), F.col("top")))
        # the first value displaces nothing: least() skips nulls, so it is cleared
        d = d.withColumn("v", F.when(F.col("top").isNotNull(), F.col("v"))).drop("top")
    d = d.withColumn("reach", F.max("v").over(so_far))
    starts = d.groupBy("query_id", "strand", "q").agg(F.max("reach").alias("reach"))
    at = Window.partitionBy("query_id", "strand").orderBy("q")
    keep = starts.withColumn("last", F.lag("reach").over(at)).where(F.col("reach").isNotNull() & (F.col("last").isNull() | (F.col("last") != F.col("reach")))).where(F.col("reach") - F.col("q") >= min_length)
    # a match is looked up in the stretches of the query that it reaches, so that the join has no quadratic part but within one
    stretch = lambda c: F.floor(F.col(c) / STRETCH)
    keep = keep.select("query_id", "strand", F.col("q").alias("start"), "reach", stretch("q").alias("stretch"))
    reaches = m.withColumn("stretch", F.explode(F.sequence(stretch("q"), stretch("e"))))
    hit = reaches.join(keep, ["query_id", "strand", "stretch"]).where((F.col("q") <= F.col("start")) & (F.col("e") >= F.col("reach")))
    rows = hit.select("query_id", "strand", "query_length", "sequence_id", (F.col("r") + F.col("start") - F.col("q")).alias("r"), F.col("start").alias("q"), (F.col("reach") - F.col("start")).alias("length"), F.col("reach").alias("e"))
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id", "strand", "q", "e"))
    return _public(rows.withColumn("reference_occurrences", n), "reference_occurrences").select("query_id", "sequence_id", "reference_position", "query_position", "length", "reference_occurrences", "strand")


def top_matches(matches: DataFrame, max_matches: int) -> DataFrame:
    """The first ``max_matches`` of each query in the fixed order."""
    require(max_matches >= 0, "max_matches must not be negative")
    by = Window.partitionBy("query_id").orderBy("query_position", "sequence_id", "reference_position", "length", "strand")
    return matches.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= max_matches).drop("_n")


def match_summary(matches: DataFrame, queries: DataFrame, max_matches: int | None = None) -> DataFrame:
    """query_id, total_matches and truncated of every query; with reference_occurrences also total_smems."""
    aggs = [F.count(F.lit(1)).alias("total_matches")]
    if "reference_occurrences" in matches.columns:
        aggs.append(F.countDistinct("query_position", "length", "strand").alias("total_smems"))
    s = queries.select("query_id").join(matches.groupBy("query_id").agg(*aggs), "query_id", "left").fillna(0)
    return s.withColumn("truncated", F.lit(False) if max_matches is None else F.col("total_matches") > max_matches)


def search_statistics(reference: DataFrame, queries: DataFrame, min_length: int = 20, strands: str = "forward") -> DataFrame:
    """The work of a maximal search by query: words looked up, those without a place, pairs of equal words, matches.

    Every query has a row; one without words has zeros. Query ids are unique.
    """
    _check(min_length, strands, "auto")
    found = cut(seeds(reference, queries, min_length, strands), "seeds")
    asked = words(strand_expand(queries.select("query_id", "sequence"), strands), ["query_id", "strand"], "sequence", min_length).groupBy("query_id").agg(F.count(F.lit(1)).alias("lookups"))
    at = found.groupBy("query_id", "strand", "qpos").agg(F.count(F.lit(1)).alias("n")).groupBy("query_id").agg(F.count(F.lit(1)).alias("_full"), F.sum("n").alias("seeds"))
    m = _islands(found, min_length, min_length).groupBy("query_id").agg(F.count(F.lit(1)).alias("matches"))
    d = queries.select("query_id").join(asked, "query_id", "left").join(at, "query_id", "left").join(m, "query_id", "left").fillna(0)
    return d.select("query_id", "lookups", (F.col("lookups") - F.col("_full")).alias("empty_lookups"), "seeds", "matches")
