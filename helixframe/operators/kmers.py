"""Words of fixed length from long sequences, and strands of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.dna import STRANDS, reverse_complement

#: Sequences are cut twice, so that no substring walks far and no row carries a long string per word; CHUNK divides PIECE.
PIECE, CHUNK = 1 << 16, 128


def _cut(seq: Column, step: int, overlap: int, k: int, size: int | None = None) -> Column:
    """Array of (at, part): parts of ``step`` characters and the ``overlap`` that follow, as long as ``k`` characters are left; parts begin below ``size``."""
    last = F.greatest(F.length(seq) - k, F.lit(0))
    if size is not None:
        last = F.least(last, F.lit(size - 1))  # what follows is the next piece's
    return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.struct(i.alias("at"), F.substring(seq, i + 1, F.lit(step + overlap)).alias("part")))


def words(df: DataFrame, keep: list[str], seq: str, k: int, ahead: int = 0) -> DataFrame:
    """``keep``, pos and word: every word of ``k`` bases without N, and with ``ahead`` the bases from it on."""
    reach = max(k, ahead) - 1
    pieces = df.select(*keep, F.explode(_cut(F.col(seq), PIECE, reach, k)).alias("c")).select(*keep, F.col("c.at").alias("at0"), F.col("c.part").alias("part0"))
    chunks = pieces.select(*keep, "at0", F.explode(_cut(F.col("part0"), CHUNK, reach, k, PIECE)).alias("c")).select(*keep, (F.col("at0") + F.col("c.at")).alias("at1"), F.col("c.part").alias("part1"))
    chunks = chunks.where(F.length("part1") >= k)
    n = F.least(F.lit(CHUNK), F.length("part1") - k + 1)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.substring("part1", i + 1, F.lit(k)).alias("word"), *([F.substring("part1", i + 1, F.lit(ahead)).alias("ahead")] if ahead else [])))
    rows = chunks.select(*keep, "at1", F.explode(F.filter(each, lambda x: ~F.contains(x["word"], F.lit("N")))).alias("w"))
    return rows.select(*keep, (F.col("at1") + F.col("w.i")).cast("long").alias("pos"), F.col("w.word").alias("word"), *([F.col("w.ahead").alias("ahead")] if ahead else []))


def strand_expand(queries: DataFrame, strands: str = "forward", seq: str = "sequence") -> DataFrame:
    """A row for each strand searched: strand, and the sequence as it is searched."""
    if strands not in STRANDS:
        raise EngineError("invalid_input", f"unknown strand {strands!r}")
    turned = {"+": F.col(seq), "-": reverse_complement(F.col(seq))}
    return queries.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(s).alias("strand"), turned[s].alias("seq")) for s in STRANDS[strands]]))).withColumn("strand", F.col("_s.strand")).withColumn(seq, F.col("_s.seq")).drop("_s")


def query_runs(queries: DataFrame) -> DataFrame:
    """query_id, run_start, run: maximal stretches of bases without a break."""
    at = F.transform(F.split("sequence", "N"), lambda x, i: x)
    ends = F.aggregate(at, F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<s:int,r:string>>").alias("o")), lambda acc, x: F.struct((acc["p"] + F.length(x) + 1).alias("p"), F.when(x != "", F.concat(acc["o"], F.array(F.struct(acc["p"].alias("s"), x.alias("r"))))).otherwise(acc["o"]).alias("o")), lambda acc: acc["o"])
    return queries.select("query_id", F.explode(ends).alias("x")).select("query_id", F.col("x.s").cast("long").alias("run_start"), F.col("x.r").alias("run"))
