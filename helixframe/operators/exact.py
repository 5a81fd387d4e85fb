"""Exact count and locate of many patterns at once: equal words joined, then the rest of the pattern compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError, require
from ..functions.dna import STRANDS, is_palindrome, pattern_valid, reverse_complement
from .kmers import words

MAX_SEED = 31
#: Fixed names of the search algorithms; all give the same rows, and one plan answers all.
ALGORITHMS = {"auto": None, "binary": None, "lcp-binary": None, "sapling-pwl": "pwl", "child": "child"}


def check_algorithm(algorithm: str, stored: set[str] | None = None) -> None:
    """An unknown name, and one whose table a stored index lacks (``stored``: the tables it holds), is refused."""
    if algorithm not in ALGORITHMS:
        raise EngineError("unsupported_backend", f"unknown algorithm {algorithm!r}")
    need = ALGORITHMS[algorithm]
    if stored is not None and need and need not in stored:
        raise EngineError("unsupported_backend", f"algorithm {algorithm!r} needs the table {need!r}")


def check_patterns(patterns: DataFrame) -> None:
    """One bad pattern refuses the batch."""
    bad = patterns.where(~pattern_valid(F.col("pattern"))).select("query_id").first()
    require(bad is None, f"pattern {bad['query_id'] if bad else ''!r} is empty or has characters other than bases")


def stranded(patterns: DataFrame, strands: str) -> DataFrame:
    """(query_id, strand, p); a palindrome is searched once on both strands."""
    require(strands in STRANDS, f"unknown strand {strands!r}")
    p = patterns.select("query_id", F.translate("pattern", "acgt", "ACGT").alias("p"))
    rc, same = reverse_complement(F.col("p")), is_palindrome(F.col("p"))
    row = lambda s, c: F.struct(s.alias("strand"), c.alias("p"))
    if strands == "both":
        each = F.when(same, F.array(row(F.lit("both"), F.col("p")))).otherwise(F.array(row(F.lit("+"), F.col("p")), row(F.lit("-"), rc)))
    else:
        s = STRANDS[strands][0]
        each = F.array(row(F.lit(s), F.col("p") if s == "+" else rc))
    return p.select("query_id", F.explode(each).alias("x")).select("query_id", "x.*")


def _hits(reference: DataFrame, patterns: DataFrame, strands: str, broadcast_rows: int = 200_000) -> DataFrame:
    """Hits by classes of pattern lengths, so that a short pattern does not shorten the words of the long ones."""
    size = F.length("pattern")
    classes = patterns.groupBy(F.when(size < 8, 0).when(size < 16, 1).otherwise(2).alias("c")).agg(F.min(size).alias("lo"), F.max(size).alias("hi"), F.count(F.lit(1)).alias("n")).collect()  # three rows at most
    q = stranded(patterns, strands)
    parts = []
    for s in sorted(classes, key=lambda r: r["c"]) or [{"lo": 1, "hi": 1, "n": 0}]:
        k, longest = min(s["lo"], MAX_SEED), s["hi"]
        mine = q.where(F.length("p").between(s["lo"], s["hi"])).withColumn("word", F.substring("p", 1, k))
        r = words(reference, ["sequence_id", "name"], "sequence", k, ahead=longest if longest > k else 0)
        hit = r.join(F.broadcast(mine) if s["n"] <= broadcast_rows else mine, "word")
        if longest > k:
            hit = hit.where(F.startswith("ahead", "p")).drop("ahead")
        parts.append(hit.drop("word"))
    return reduce(DataFrame.unionByName, parts)


def first_hits(hits: DataFrame, max_hits: int) -> DataFrame:
    """The first ``max_hits`` of each query in the fixed order."""
    by = Window.partitionBy("query_id").orderBy("sequence_id", "position", "length", "strand")
    return hits.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= max_hits).drop("_n")


def locate(reference: DataFrame, patterns: DataFrame, strands: str = "forward", max_hits: int | None = None, algorithm: str = "auto") -> DataFrame:
    """query_id, sequence_id, sequence_name, position, length, strand; with ``max_hits`` the first so many of each query."""
    check_algorithm(algorithm)
    check_patterns(patterns)
    rows = _hits(reference, patterns, strands).select("query_id", "sequence_id", F.col("name").alias("sequence_name"), F.col("pos").alias("position"), F.length("p").cast("long").alias("length"), "strand")
    return rows if max_hits is None else first_hits(rows, max_hits)


def locate_first(reference: DataFrame, patterns: DataFrame, strands: str = "forward") -> DataFrame:
    """The first hit of each query that has one, by a minimum and not a sort."""
    check_patterns(patterns)
    at = F.min(F.struct("sequence_id", F.col("pos").alias("position"), F.length("p").cast("long").alias("length"), "strand"))
    return _hits(reference, patterns, strands).groupBy("query_id").agg(at.alias("h")).select("query_id", "h.*")


def count(reference: DataFrame, patterns: DataFrame, strands: str = "forward", algorithm: str = "auto") -> DataFrame:
    """query_id, total_hits of every pattern, zero included; duplicate patterns keep their own rows."""
    check_algorithm(algorithm)
    check_patterns(patterns)
    n = _hits(reference, patterns, strands).groupBy("query_id").agg(F.count(F.lit(1)).alias("total_hits"))
    return patterns.select("query_id").join(n, "query_id", "left").fillna(0, ["total_hits"])


def locate_summary(reference: DataFrame, patterns: DataFrame, strands: str = "forward", max_hits: int | None = None) -> DataFrame:
    """query_id, total_hits, truncated."""
    n = count(reference, patterns, strands)
    return n.withColumn("truncated", F.lit(False) if max_hits is None else F.col("total_hits") > max_hits)
