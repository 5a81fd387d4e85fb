"""The queries of the sequence engine over the driver's tables, and DuckDB SQL that says the same another way."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import analytics, exact, index, kmers, maximal, reference
from ..session import cut, shared_folder, ship
from ..sources import fasta, tables
from . import fixtures as fx
from . import oracles

Query = Callable[[SparkSession, str], DataFrame]
L_MEM, L_UNIQUE, RATE = 16, 12, 4


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _reference_queries() -> dict[str, Query]:
    def fasta_scan(s: SparkSession, d: str) -> DataFrame:
        path = _scratch(s, "fasta")
        line = F.concat(F.lit(">"), F.col("name"), F.lit(" passage > of text\n"), F.col("sequence"))
        fx.records(s, d).select(line.alias("value")).write.text(path)
        return fasta.read_fasta(s, path).select("name", "description", "sequence")

    def raw(s: SparkSession, d: str) -> DataFrame:
        docs = s.read.parquet(f"{d}/documents.parquet")
        return docs.select("doc_id", dna.normalize_bases(F.col("text")).alias("sequence")).withColumn("ambiguous_bases", dna.ambiguous_bases(F.col("sequence")))

    def map_global(s: SparkSession, d: str) -> DataFrame:
        c = fx.reference(s, d)
        symbols = reference.reference_stats(c).first()["text_symbols"]
        places = s.range(symbols).select(F.col("id").alias("global_pos"), F.lit(10).cast("long").alias("length"))
        return reference.map_global(c, places)

    def tsv(s: SparkSession, d: str) -> DataFrame:
        path = _scratch(s, "tsv")
        c = reference.contig_offsets(fx.reference(s, d)).withColumn("description", F.lit(None).cast("string"))
        tables.write_tsv(c, path)
        return tables.read_tsv(s, path, c.schema.simpleString()[7:-1].replace(":", " "))

    def saved(s: SparkSession, d: str) -> str:
        c = fx.reference(s, d)
        path = _scratch(s, "saved")
        tables.save_index({"contigs": c, "offsets": reference.contig_offsets(c)}, path, reference.reference_stats(c).first().asDict())
        return path

    return {
        "fasta_scan": fasta_scan,
        "normalize_reference": raw,
        "logical_text": lambda s, d: reference.logical_text(fx.reference(s, d)),
        "reference_stats": lambda s, d: reference.reference_stats(fx.reference(s, d)),
        "fingerprint": lambda s, d: reference.fingerprint(fx.reference(s, d)),
        "sequence_info": lambda s, d: reference.sequence_info(fx.reference(s, d), 3),
        "contig_offsets": lambda s, d: reference.contig_offsets(fx.reference(s, d)),
        "map_global": map_global,
        "tsv_roundtrip": tsv,
        "index_roundtrip": lambda s, d: tables.load_index(s, saved(s, d))["offsets"],
        "inspect": lambda s, d: tables.inspect_index(s, saved(s, d)),
        "backends": lambda s, d: tables.available_backends(s),
        "pattern_valid": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", dna.pattern_valid(F.translate("p_name", " abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTACG")).alias("valid")),
        "query_runs": lambda s, d: kmers.query_runs(fx.queries(s, d)),
        "reverse_complement": lambda s, d: fx.queries(s, d).select("query_id", dna.reverse_complement(F.col("sequence")).alias("sequence")),
        "is_palindrome": lambda s, d: fx.patterns(s, d).select("query_id", dna.is_palindrome(F.upper("pattern")).alias("palindrome")),
        "kmers": lambda s, d: kmers.words(fx.reference(s, d), ["sequence_id"], "sequence", L_MEM),
        "kmer_key": lambda s, d: kmers.words(fx.reference(s, d), ["sequence_id"], "sequence", 31).select("sequence_id", "pos", dna.kmer_key(F.col("word")).alias("key")),
        "strand_expand": lambda s, d: kmers.strand_expand(fx.queries(s, d), "both").select("query_id", "strand", "sequence"),
        "result_checksum": lambda s, d: reference.result_checksum(maximal.mem(fx.reference(s, d), fx.queries(s, d), L_MEM), maximal.COLUMNS),
    }


def _exact_queries() -> dict[str, Query]:
    both = lambda f, **o: lambda s, d: f(fx.reference(s, d), fx.patterns(s, d), **o)
    out: dict[str, Query] = {}
    for strands in ("forward", "reverse", "both"):
        out[f"exact_count_{strands}"] = both(exact.count, strands=strands)
        out[f"exact_locate_{strands}"] = both(exact.locate, strands=strands)
    out["ordered_checksum"] = lambda s, d: reference.ordered_checksum(out["exact_count_both"](s, d), out["exact_locate_both"](s, d))
    out["locate_top_k"] = both(exact.locate, strands="both", max_hits=2)
    out["locate_first"] = both(exact.locate_first, strands="both")
    out["locate_count_only"] = both(exact.count, strands="both")
    out["locate_summary"] = both(exact.locate_summary, strands="both", max_hits=1)
    return out


def _maximal_queries() -> dict[str, Query]:
    run = lambda f, n, strands="forward", **o: lambda s, d: f(fx.reference(s, d), fx.queries(s, d), n, strands=strands, **o)
    out: dict[str, Query] = {}
    for strands in ("forward", "reverse", "both"):
        out[f"mem_{strands}"] = run(maximal.mem, L_MEM, strands)
    for strands in ("forward", "both"):
        out[f"right_maximal_{strands}"] = run(maximal.right_maximal, L_MEM, strands)
        out[f"mam_{strands}"] = run(maximal.mam, L_UNIQUE, strands)
        out[f"mum_{strands}"] = run(maximal.mum, L_UNIQUE, strands)
    out["right_maximal_sampled"] = run(maximal.right_maximal, L_MEM, sampling_rate=RATE)
    out["mem_skip"] = run(maximal.mem, L_MEM, skip=3)
    for c in (1, 2, 3):
        out[f"smem_c{c}"] = run(maximal.smem, L_UNIQUE, "both", min_occurrences=c)
    out["search_statistics"] = run(maximal.search_statistics, L_MEM, "both")
    out["mem_top_k"] = lambda s, d: maximal.top_matches(run(maximal.mem, L_UNIQUE)(s, d), 3)
    out["mem_summary"] = lambda s, d: maximal.match_summary(run(maximal.mem, L_MEM)(s, d), fx.queries(s, d), 1)
    out["smem_summary"] = lambda s, d: maximal.match_summary(run(maximal.smem, L_UNIQUE, "both", min_occurrences=2)(s, d), fx.queries(s, d))
    return out


def _index_queries() -> dict[str, Query]:
    def parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        c = fx.reference(s, d)
        symbols = cut(reference.text_symbols(c))
        return c, symbols, index.suffix_array(symbols)

    def named(f: Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]) -> Query:
        return lambda s, d: f(*parts(s, d), fx.patterns(s, d))

    bw = lambda t, sa: cut(index.bwt(t, sa))

    def predict(c: DataFrame, t: DataFrame, sa: DataFrame, p: DataFrame) -> DataFrame:
        keys = p.where("length(pattern) >= 12").select(dna.kmer_key(F.substring(F.upper("pattern"), 1, 12)).alias("key")).distinct()
        return index.learned_predict(cut(index.learned_anchors(c, sa)), keys, t.count())

    def batch(c: DataFrame, t: DataFrame, sa: DataFrame, p: DataFrame) -> DataFrame:
        twice = p.select(F.concat(F.lit("x"), "query_id").alias("query_id"), "pattern").unionByName(p)  # duplicates keep their rows
        return index.fm_equal_range(bw(t, sa), index.c_table(t), twice)

    fm = lambda c, t, sa, p: index.fm_equal_range(bw(t, sa), index.c_table(t), p)
    width = lambda r: r.select("query_id", (F.col("end") - F.col("begin")).alias("total_hits"))

    def suffix_at(c: DataFrame, t: DataFrame, sa: DataFrame, p: DataFrame) -> DataFrame:
        return index.suffix_at(sa, index.range_rows(index.equal_range(c, sa, p)).select("row").distinct())

    def corrupt(c: DataFrame, t: DataFrame, sa: DataFrame, p: DataFrame) -> DataFrame:
        return index.validate_index(t, sa.select("row", F.when(F.col("row") % 97 == 3, F.col("suffix") + 1).otherwise(F.col("suffix")).alias("suffix")).where("row <> 8"))

    return {
        "equal_range": named(lambda c, t, sa, p: index.equal_range(c, sa, p)),
        "prefix_directory": named(lambda c, t, sa, p: index.prefix_directory(c, sa)),
        "suffix_array": named(lambda c, t, sa, p: sa),
        "suffix_at": named(suffix_at),
        "sampled_sa": named(lambda c, t, sa, p: index.sampled_suffix_array(sa, RATE)),
        "sampled_count": named(lambda c, t, sa, p: index.sampled_count(c, index.sampled_suffix_array(sa, RATE), RATE, p)),
        "isa": named(lambda c, t, sa, p: index.inverse_suffix_array(sa)),
        "lcp_array": named(lambda c, t, sa, p: index.lcp_array(t)),
        "sampled_lcp": named(lambda c, t, sa, p: index.sampled_lcp(index.lcp_array(t), RATE)),
        "lcp_bytecoded": named(lambda c, t, sa, p: index.byte_coded_lcp(index.lcp_array(t))),
        "child_table": named(lambda c, t, sa, p: index.child_table(index.lcp_array(t))),
        "pwl_anchors": named(lambda c, t, sa, p: index.learned_anchors(c, sa)),
        "pwl_predict": named(predict),
        "storage_width": lambda s, d: index.storage_width(fx.reference(s, d)),
        "validate_index": named(lambda c, t, sa, p: index.validate_index(t, sa)),
        "validate_corrupt_index": named(corrupt),
        "bwt": named(lambda c, t, sa, p: index.bwt(t, sa)),
        "c_table": named(lambda c, t, sa, p: index.c_table(t)),
        "fm_equal_range": named(fm),
        "fm_equal_range_batch": named(batch),
        "fm_count_batch": named(lambda c, t, sa, p: width(batch(c, t, sa, p))),
        **{f"fm_count{name}": named(lambda c, t, sa, p, s=strands: index.fm_count(bw(t, sa), index.c_table(t), p, s)) for name, strands in (("", "forward"), ("_both", "both"))},
        "fm_locate": named(lambda c, t, sa, p: index.fm_locate(c, bw(t, sa), index.c_table(t), sa, p).select("query_id", "sequence_id", "position")),
        "fm_locate_both": named(lambda c, t, sa, p: index.fm_locate(c, bw(t, sa), index.c_table(t), sa, p, "both")),
        "fm_locate_top_k": named(lambda c, t, sa, p: index.fm_locate(c, bw(t, sa), index.c_table(t), sa, p, "both", max_hits=2)),
    }


def _analytics_queries() -> dict[str, Query]:
    keys = ["dataset", "method", "operation"]
    rounded = lambda df, *cs: df.withColumns({c: F.round(c, 6) for c in cs})
    derived = ("median_seconds", "min_seconds", "max_seconds", "qps", "ns_per_query", "bases_per_second")
    summary = lambda s, d: analytics.summarise(fx.repetitions(s, d), keys)

    def hits(s: SparkSession, d: str) -> DataFrame:
        return s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("total_hits"))

    def audit(s: SparkSession, d: str) -> DataFrame:
        r = fx.repetitions(s, d).where("status = 'ok' AND NOT (dataset = 'R' AND operation = 'op1')")
        values = lambda c, v: s.createDataFrame([(x,) for x in v], f"{c} string")
        return analytics.audit_missing(r, [values("dataset", "ANR"), values("method", "FO"), values("operation", ["op0", "op1", "op2"])])

    return {
        "bench_summary": lambda s, d: rounded(summary(s, d), *derived),
        "bench_speedup": lambda s, d: rounded(analytics.speedup(summary(s, d), ["dataset", "operation"], "method", "F"), "speedup").select(*keys, "speedup"),
        "nearest_rank": lambda s, d: analytics.nearest_rank(fx.repetitions(s, d), ["dataset"], "query_bases"),
        "gate_equality": lambda s, d: analytics.gate_equality(fx.repetitions(s, d), ["dataset", "operation", "repetition"], ["checksum", "method"]),
        "hit_buckets": lambda s, d: hits(s, d).groupBy(analytics.hit_bucket(F.col("total_hits")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("total_hits").alias("total_hits")),
        "high_freq_skip": lambda s, d: analytics.split_high_frequency(hits(s, d), 12),
        "bench_headline": lambda s, d: rounded(analytics.headline(fx.repetitions(s, d), ["dataset", "operation"], ["method", "checksum"]), "median_seconds"),
        "bench_detail": lambda s, d: rounded(analytics.detail(fx.repetitions(s, d), [["dataset"], ["dataset", "method"], keys]), "median_seconds"),
        "bench_correctness": lambda s, d: analytics.correctness(fx.repetitions(s, d), keys, "checksum"),
        "union_by_name": lambda s, d: analytics.union_by_name([s.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation")), s.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region"))]),
        "audit_missing": audit,
        "environment": lambda s, d: analytics.environment(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))),
    }


def _ready(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    every = _reference_queries() | _exact_queries() | _maximal_queries() | _index_queries() | _analytics_queries()
    return {name: _ready(f) for name, f in every.items()}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
