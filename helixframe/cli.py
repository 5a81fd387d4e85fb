"""Command line: ``python -m helixframe build|query|right-maximal|mem|mam|smem|mum|inspect``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError, require
from .functions.dna import normalize_bases
from .operators import exact, index, maximal, reference
from .session import cut, local_session, ship
from .sources import tables
from .sources.fasta import read_fasta

EXACT = ["query_id", "sequence_id", "sequence_name", "start", "end", "strand"]
MAXIMAL = ["query_id", "sequence_id", "sequence_name", "reference_start", "query_start", "length", "strand"]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixframe")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("--type", choices=("sa", "fm"), default="sa")
    b.add_argument("--reference", required=True)
    b.add_argument("--output", required=True)
    b.add_argument("--overwrite", action="store_true")
    b.add_argument("--sampling-rate", type=int, default=1)
    q = sub.add_parser("query")
    q.add_argument("--index", required=True)
    q.add_argument("--pattern")
    q.add_argument("--query")
    q.add_argument("--strand", default="forward")
    q.add_argument("--algorithm", default="auto")
    q.add_argument("--batch-width", type=int, default=0)
    q.add_argument("--count-only", action="store_true")
    q.add_argument("--max-hits", type=int)
    for name in ("right-maximal", "mem", "mam", "smem", "mum"):
        m = sub.add_parser(name)
        m.add_argument("--index", required=True)
        m.add_argument("--query", required=True)
        m.add_argument("--min-length", type=int, default=20)
        m.add_argument("--strand", default="forward")
        m.add_argument("--algorithm", default="auto")
        m.add_argument("--max-matches", type=int)
        if name == "mem":
            m.add_argument("--skip", type=int)
        if name == "smem":
            m.add_argument("--min-occurrences", type=int, default=1)
    i = sub.add_parser("inspect")
    i.add_argument("--index", required=True)
    return p


def build(spark: SparkSession, kind: str, fasta: str, output: str, overwrite: bool, rate: int) -> None:
    contigs = reference.reference_from_records(read_fasta(spark, fasta))
    symbols = reference.text_symbols(contigs)
    sa = cut(index.suffix_array(cut(symbols)))
    sections = {"contigs": contigs, "symbols": symbols}
    sections |= {"sa": index.sampled_suffix_array(sa, rate) if rate > 1 else sa} if kind == "sa" else {"bwt": index.bwt(symbols, sa), "c_table": index.c_table(symbols), "sa": sa}
    stats = {**reference.reference_stats(contigs).first().asDict(), **reference.fingerprint(contigs).first().asDict()}
    tables.save_index(sections, output, {"type": kind, "sampling_rate": rate, **stats}, overwrite)


def _queries(spark: SparkSession, path: str) -> DataFrame:
    q = read_fasta(spark, path).select(F.col("name").alias("query_id"), "sequence")
    require(q.where("query_id = ''").limit(1).count() == 0, "empty query name")
    require(q.groupBy("query_id").count().where("count > 1").limit(1).count() == 0, "query names must differ")
    return q


def _maximal(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    kind = tables.read_manifest(spark, a.index)["properties"]
    if kind.get("type") != "sa":
        raise EngineError("unsupported_backend", "maximal matches need a suffix-array index")
    contigs = tables.load_index(spark, a.index)["contigs"]
    q = _queries(spark, a.query).withColumn("sequence", normalize_bases(F.col("sequence")))
    options = {"min_length": a.min_length, "strands": a.strand, "algorithm": a.algorithm}
    rate = int(kind.get("sampling_rate", 1))
    if a.command == "mem":
        m = maximal.mem(contigs, q, skip=a.skip, **options)
    elif a.command == "smem":
        m = maximal.smem(contigs, q, min_occurrences=a.min_occurrences, sampling_rate=rate, **options)
    else:
        m = {"right-maximal": maximal.right_maximal, "mam": maximal.mam, "mum": maximal.mum}[a.command](contigs, q, sampling_rate=rate, **options)
    if a.max_matches is not None:
        m = maximal.top_matches(m, a.max_matches)
    columns = [*MAXIMAL[:-1], "reference_occurrences", "strand"] if a.command == "smem" else MAXIMAL
    m = m.join(contigs.select("sequence_id", F.col("name").alias("sequence_name")), "sequence_id")
    return m.withColumnsRenamed({"reference_position": "reference_start", "query_position": "query_start"}).select(*columns).orderBy("query_id", "query_start", "sequence_id", "reference_start", "length", "strand")


def _exact(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """An FM index is searched backwards; beside a suffix array the contigs are searched by words."""
    held = tables.load_index(spark, a.index)
    fm = tables.read_manifest(spark, a.index)["properties"].get("type") == "fm"
    exact.check_algorithm(a.algorithm, set(held))
    p = spark.createDataFrame([("query_0", a.pattern)], "query_id string, pattern string") if a.pattern is not None else _queries(spark, a.query).withColumnRenamed("sequence", "pattern")
    if a.count_only:
        rows = index.fm_count(held["bwt"], held["c_table"], p, a.strand, batch_width=a.batch_width) if fm else exact.count(held["contigs"], p, a.strand)
        return rows.orderBy("query_id")
    hits = index.fm_locate(held["contigs"], held["bwt"], held["c_table"], held["sa"], p, a.strand, a.max_hits, batch_width=a.batch_width) if fm else exact.locate(held["contigs"], p, a.strand, a.max_hits)
    return hits.withColumn("start", F.col("position")).withColumn("end", F.col("position") + F.col("length")).orderBy("query_id", "sequence_id", "position", "length", "strand").select(*EXACT)


def run(spark: SparkSession, argv: list[str], out=sys.stdout) -> int:
    """Exit code; results go to ``out`` as tab-separated rows under a header."""
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        if a.command == "build":
            build(spark, a.type, a.reference, a.output, a.overwrite, a.sampling_rate)
            return 0
        if a.command == "inspect":
            rows = tables.inspect_index(spark, a.index)
        elif a.command == "query":
            require((a.pattern is None) != (a.query is None), "give --pattern or --query", "invalid_argument")
            rows = _exact(spark, a)
        else:
            rows = _maximal(spark, a)
        print("\t".join(rows.columns), file=out)
        for r in rows.toLocalIterator():
            print("\t".join("NA" if v is None else str(v) for v in r), file=out)
        return 0
    except EngineError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return e.exit_code


def main() -> int:
    spark = local_session()
    ship(spark)
    return run(spark, sys.argv[1:])
