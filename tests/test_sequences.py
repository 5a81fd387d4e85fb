import gzip
import io
import random

import naive
import pytest
from pyspark.sql import functions as F

from helixframe import cli
from helixframe.errors import EngineError
from helixframe.functions import dna
from helixframe.operators import exact, index, kmers, maximal, reference
from helixframe.plans import fixtures, registry
from helixframe.session import cut
from helixframe.sources import fasta, tables
from helixframe.streaming.queries import for_each_match, search_stream

CORE = ["acgtNACGT", "TTTACGTAAA", "AAA"]


def contigs(spark, seqs):
    rows = [(i, f"chr{i + 1}", "", s) for i, s in enumerate(seqs)]
    return reference.reference_from_records(spark.createDataFrame(rows, "seq_order long, name string, description string, sequence string"))


def queries(spark, seqs):
    return spark.createDataFrame([(str(i), naive.norm(s)) for i, s in enumerate(seqs)], "query_id string, sequence string")


def patterns(spark, ps):
    return spark.createDataFrame([(p, p) for p in ps], "query_id string, pattern string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_core_reference(spark):
    c = contigs(spark, CORE)
    assert tuple(reference.reference_stats(c).first()) == (3, 22, 1, 26)
    assert [r["global_offset"] for r in reference.contig_offsets(c).orderBy("sequence_id").collect()] == [0, 10, 21]
    assert contigs(spark, ["aCuR-"]).first()["ambiguous_bases"] == 3
    text = reference.logical_text(c).first()["text"]
    assert text == "2345623451555234522212221" + "0"
    assert "".join(str(r["symbol"]) for r in reference.text_symbols(c).orderBy("pos").collect()) == text
    h = 0xCBF29CE484222325
    for ch in text[:-2]:
        h = ((h ^ int(ch)) * 0x100000001B3) % 2**64
    assert reference.fingerprint(c).first()["fingerprint"] == f"{h:016x}"


def test_map_global_of_every_place(spark):
    seqs = ["ACGT" * 9, "A", "CC", "GATTACA" * 20, "C" * 33]
    c, want, start = contigs(spark, seqs), [], 0
    for i, s in enumerate(seqs):
        want += [(start + p, n, i, p) for n in (1, 10) for p in range(len(s) - n + 1)]
        start += len(s) + 1
    at = spark.range(-3, start + 5).selectExpr("id AS global_pos", "explode(array(1L, 10L)) AS length")
    for span in (1, 7, 1 << 16):
        assert rows(reference.map_global(c, at, span)) == sorted(want)


def test_map_global_asks_for_the_whole_text(spark):
    d = "/root/testdata/sf0.1"
    c = fixtures.reference(spark, d)
    got = registry.queries()["map_global"](spark, d)
    # one row for each place that has ten bases of its contig, in every contig up to the last
    want = {r["sequence_id"]: r["length"] - 9 for r in c.where("length >= 10").collect()}
    assert {r["sequence_id"]: r["count"] for r in got.groupBy("sequence_id").count().collect()} == want
    assert got.agg(F.max("global_pos")).first()[0] > 40_000


def test_suffix_at_looks_up_the_rows_of_all_patterns(spark):
    d = "/root/testdata/sf0.001"
    got = rows(registry.queries()["suffix_at"](spark, d).select("row", "suffix"))
    text = reference.logical_text(fixtures.reference(spark, d)).first()["text"]
    order = sorted(range(len(text)), key=lambda i: text[i:])
    asked = tuple({r["pattern"].upper().translate(str.maketrans("ACGT", "2345")) for r in fixtures.patterns(spark, d).collect()})
    assert got == [(r, i) for r, i in enumerate(order) if text.startswith(asked, i)]
    assert len(got) > 4


@pytest.mark.parametrize("bad", [[], [("", "A")], [("a", "")], [("a", "A"), ("a", "C")]])
def test_bad_references(spark, bad):
    df = spark.createDataFrame([(i, n, "", s) for i, (n, s) in enumerate(bad)], "seq_order long, name string, description string, sequence string")
    with pytest.raises(EngineError) as e:
        reference.reference_from_records(df)
    assert e.value.code == "invalid_input"


def test_core_exact(spark):
    c, p = contigs(spark, CORE), patterns(spark, ["ACGT", "AAA", "GTTT", "GTAC"])
    hits = rows(exact.locate(c, p, "both").select("query_id", "sequence_id", "position", "strand"))
    assert hits == [("AAA", 1, 0, "-"), ("AAA", 1, 7, "+"), ("AAA", 2, 0, "+"), ("ACGT", 0, 0, "both"), ("ACGT", 0, 5, "both"), ("ACGT", 1, 3, "both")]
    assert dict(rows(exact.count(c, p, "both"))) == {"ACGT": 3, "AAA": 3, "GTTT": 0, "GTAC": 0}
    assert rows(exact.locate(c, p, "both", 1).select("query_id", "sequence_id", "position")) == [("AAA", 1, 0), ("ACGT", 0, 0)]
    assert rows(exact.locate_first(c, p, "both").select("query_id", "sequence_id", "position")) == [("AAA", 1, 0), ("ACGT", 0, 0)]
    assert exact.locate(c, p, "both", 0).count() == 0
    assert dict((r[0], r[2]) for r in rows(exact.locate_summary(c, p, "both", 2))) == {"ACGT": True, "AAA": True, "GTTT": False, "GTAC": False}
    with pytest.raises(EngineError):
        exact.count(c, patterns(spark, ["ACN"]))


def test_maximal_against_definitions(spark):
    rng = random.Random(5)
    for strands, least in (("forward", 1), ("both", 3), ("reverse", 2)):
        refs = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(8, 30))) for _ in range(3)]
        qs = ["".join(rng.choice("ACGTN" if i % 2 else "AC") for _ in range(rng.randint(0, 20))) for i in range(12)] + [refs[0][:9]]
        c, q = contigs(spark, refs), queries(spark, qs)
        want = {"mem": set(), "mam": set(), "mum": set(), 1: set(), 2: set(), 3: set()}
        for i, s in enumerate(qs):
            for strand in {"forward": "+", "reverse": "-", "both": "+-"}[strands]:
                t = s if strand == "+" else s.translate(naive.TURN)[::-1]
                place = lambda m, s=s, strand=strand: m[0] if strand == "+" else len(s) - m[0] - m[3]
                for name, f in (("mem", naive.mems), ("mam", naive.mams), ("mum", naive.mums)):
                    want[name] |= {(str(i), m[1], m[2], place(m), m[3], strand) for m in f(refs, t, least)}
                for k in (1, 2, 3):
                    want[k] |= {(str(i), m[1], m[2], place(m), m[3], m[4], strand) for m in naive.smems(refs, t, least, k)}
        for name, f in (("mem", maximal.mem), ("mam", maximal.mam), ("mum", maximal.mum)):
            got = rows(f(c, q, least, strands))
            assert len(got) == len(set(got)) and set(got) == want[name], (name, strands, least)
        for k in (1, 2, 3):
            assert set(rows(maximal.smem(c, q, least, k, strands))) == want[k], (k, strands, least)
        assert set(rows(maximal.right_maximal(c, q, least, strands))) == want["mem"]


def test_options_and_limits(spark):
    c, q = contigs(spark, ["TTGATTACAGGACGTACGT", "CCCCAAAATTTT"]), queries(spark, ["GATTACA", ""])
    m = maximal.mem(c, q, 4)
    assert set(rows(maximal.mem(c, q, 4, skip=2))) == set(rows(m))
    assert rows(maximal.match_summary(m, q, 0)) == [("0", m.count(), m.count() > 0), ("1", 0, False)]
    assert maximal.top_matches(m, 1).count() == 1
    for call, code in ((lambda: maximal.mem(c, q, 0), "invalid_input"), (lambda: maximal.mem(c, q, 4, "sideways"), "invalid_input"), (lambda: maximal.mem(c, q, 4, algorithm="x"), "unsupported_backend"), (lambda: maximal.mam(c, q, 4, sampling_rate=2), "unsupported_backend"), (lambda: maximal.smem(c, q, 4, 0), "invalid_input")):
        with pytest.raises(EngineError) as e:
            call()
        assert e.value.code == code


def test_words_of_long_sequences(spark, monkeypatch):
    monkeypatch.setattr(kmers, "PIECE", 49)
    monkeypatch.setattr(kmers, "CHUNK", 7)
    rng = random.Random(2)
    s = "".join(rng.choice("ACGTN") for _ in range(333))
    got = rows(kmers.words(contigs(spark, [s]), ["sequence_id"], "sequence", 5, ahead=11))
    assert got == sorted((0, i, s[i : i + 5], s[i : i + 11]) for i in range(len(s) - 4) if "N" not in s[i : i + 5])


def test_index_tables(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("AACGTN") for _ in range(n)) for n in (40, 25, 3)] + ["A" * 60]
    c = contigs(spark, seqs)
    text = reference.logical_text(c).first()["text"]
    symbols = reference.text_symbols(c)
    order = sorted(range(len(text)), key=lambda i: text[i:])
    sa = cut(index.suffix_array(symbols))
    assert [r["suffix"] for r in sa.orderBy("row").collect()] == order
    common = lambda a, b: next((k for k in range(len(text)) if text[a : a + k + 1][k:] != text[b : b + k + 1][k:] or a + k >= len(text)), 0)
    lcp = cut(index.lcp_array(symbols))
    assert [r["lcp"] for r in lcp.orderBy("row").collect()] == [0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)]
    assert tuple(index.validate_index(symbols, sa).first()) == (True, True, True, True)
    b = cut(index.bwt(symbols, sa))
    assert "".join(str(r["symbol"]) for r in b.orderBy("row").collect()) == "".join(text[i - 1] for i in order)
    p = patterns(spark, ["A", "AC", "GATTACA", "AAAAAA", "T"])
    want = rows(index.equal_range(c, sa, p))
    for held in (0, 1000):  # the distributed steps, and the held text
        assert rows(index.fm_equal_range(b, index.c_table(symbols), p, held)) == want
    sampled = index.sampled_suffix_array(sa, 3)
    assert rows(index.sampled_count(c, sampled, 3, p)) == rows(exact.count(c, p))
    child = index.child_table(lcp).orderBy("row").collect()
    v = [r["lcp"] for r in lcp.orderBy("row").collect()]
    for i, r in enumerate(child):
        after = next((j for j in range(i + 1, len(v)) if v[j] <= v[i]), None)
        assert r["next_l"] == (after if after is not None and v[after] == v[i] else None)
        before = next((j for j in range(i - 1, -1, -1) if v[j] <= v[i]), -1)
        stop = after if after is not None else len(v)
        least = lambda lo, hi: min(range(lo, hi), key=lambda j: (v[j], j), default=None)
        assert r["up"] == least(before + 1, i) and r["down"] == least(i + 1, stop)
    with pytest.raises(EngineError):
        index.equal_range(c, sa, p, sampling_rate=2)
    for strands in ("forward", "reverse", "both"):  # backward search gives what scanning the text gives
        assert rows(index.fm_count(b, index.c_table(symbols), p, strands)) == rows(exact.count(c, p, strands))
        got = index.fm_locate(c, b, index.c_table(symbols), sa, p, strands)
        assert rows(got) == rows(exact.locate(c, p, strands)) and got.columns == exact.locate(c, p, strands).columns
    assert rows(index.fm_locate(c, b, index.c_table(symbols), sa, p, "both", 2)) == rows(exact.locate(c, p, "both", 2))
    for bad in ({"backend": "sdsl-csa-sada"}, {"batch_width": 257}):
        with pytest.raises(EngineError):
            index.fm_count(b, index.c_table(symbols), p, **bad)
    assert rows(index.suffix_at(sa, spark.createDataFrame([(0,), (5,)], "row long"))) == [(0, order[0]), (5, order[5])]
    with pytest.raises(Exception, match="no row"):
        index.suffix_at(sa, spark.createDataFrame([(10**6,)], "row long")).collect()
    broken = sa.withColumn("suffix", F.when(F.col("row") == 4, 0).otherwise(F.col("suffix")))
    assert tuple(index.validate_index(symbols, broken).first()) == (True, False, True, True)
    assert tuple(index.validate_index(symbols, sa.where("row <> 7")).first()) == (False, False, False, True)
    for algorithm, stored, ok in (("binary", None, True), ("child", {"child"}, True), ("child", {"sa"}, False), ("sapling-pwl", {"sa"}, False), ("x", None, False)):
        if ok:
            exact.check_algorithm(algorithm, stored)
        else:
            with pytest.raises(EngineError):
                exact.check_algorithm(algorithm, stored)


@pytest.mark.parametrize("bucket", [1, 7, 1 << 16])
def test_sampled_lcp_is_the_least_between_kept_rows(spark, bucket):
    rng = random.Random(bucket)
    values = [(i, p, 0 if i == 0 else rng.randint(0, 9)) for i, p in enumerate(rng.sample(range(60), 60))]
    lcp = spark.createDataFrame(values, "row long, suffix long, lcp long")
    for rate in (1, 2, 5, 59):
        kept = [i for i, p, _ in values if p % rate == 0]
        want = [(n, values[i][1], min(values[j][2] for j in range(kept[n - 1] + 1, i + 1)) if n else 0) for n, i in enumerate(kept)]
        assert rows(index.sampled_lcp(lcp, rate, bucket)) == want
    assert index.sampled_lcp(lcp.where("false"), 4, bucket).count() == 0
    with pytest.raises(EngineError):
        index.sampled_lcp(lcp, 0)


def test_ordered_checksum_depends_on_order(spark):
    c, p = contigs(spark, CORE), patterns(spark, ["AAA", "ACGT", "GTTT"])
    hits, counts = exact.locate(c, p, "both"), exact.count(c, p, "both")
    h, n = 0xCBF29CE484222325, 0
    for q, total in rows(counts):
        for values in [(total,)] + [(i, at, k, "+-b".index(s[0])) for _, i, at, k, s in rows(hits.where(F.col("query_id") == q).drop("sequence_name"))]:
            n += 1
            for b in b"".join(x.to_bytes(8, "little") for x in values):
                h = ((h ^ b) * 0x100000001B3) % 2**64
    assert tuple(reference.ordered_checksum(counts, hits).first()) == (n, f"{h:016x}")
    swapped = F.when(F.col("query_id") == "AAA", "ACGT").when(F.col("query_id") == "ACGT", "AAA").otherwise(F.col("query_id"))
    other = reference.ordered_checksum(counts.withColumn("query_id", swapped), hits.withColumn("query_id", swapped)).first()
    assert other["n_rows"] == n and other["checksum"] != f"{h:016x}"
    assert tuple(reference.ordered_checksum(counts.where("false"), hits.where("false")).first()) == (0, "cbf29ce484222325")


def test_search_statistics(spark):
    c, q = contigs(spark, ["GATTACAGATTACA", "ACGTN"]), queries(spark, ["CGATTACC", "ANACGT", "", "AC"])
    # words of three bases: CGA GAT ATT TTA TAC ACC, then ACG CGT after the N
    assert rows(maximal.search_statistics(c, q, 3)) == [("0", 6, 2, 8, 2), ("1", 2, 0, 2, 1), ("2", 0, 0, 0, 0), ("3", 0, 0, 0, 0)]
    both = {r[0]: r[1] for r in rows(maximal.search_statistics(c, q, 3, "both"))}
    assert both == {"0": 12, "1": 4, "2": 0, "3": 0}


def test_fasta_and_tables(spark, tmp_path):
    text = ">chr1 first one\r\nACGT\nNN\n\n>chr2\nTT\n>empty\n"
    (tmp_path / "a.fa").write_text(text)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(text)
    want = [(0, "chr1", "first one", "ACGTNN"), (1, "chr2", "", "TT"), (2, "empty", "", "")]
    spark.dataSource.register(fasta.FastaDataSource)
    for name in ("a.fa", "b.fa.gz"):
        assert rows(fasta.read_fasta(spark, str(tmp_path / name))) == want
        assert rows(spark.read.format("fasta").load(str(tmp_path / name))) == want
    c = contigs(spark, CORE)
    path = "file://" + str(tmp_path / "index")
    tables.save_index({"contigs": c}, path, {"type": "sa"})
    assert rows(tables.load_index(spark, path)["contigs"]) == rows(c)
    with pytest.raises(EngineError) as e:
        tables.save_index({"contigs": c}, path)
    assert e.value.code == "io_error"
    tables.save_index({"contigs": c}, path, overwrite=True)
    spark.createDataFrame([(1, "x", "", "A", 1, 0)], c.schema.simpleString()[7:-1].replace(":", " ")).write.mode("append").parquet(path + "/contigs")
    with pytest.raises(EngineError) as e:
        tables.load_index(spark, path)
    assert e.value.code == "corrupt_index" and tables.load_index(spark, path, validate=False)["contigs"].count() == 4
    with pytest.raises(EngineError):
        tables.read_manifest(spark, path + "-none")


ODD_FASTA = [
    ">s1 len>5 copy\nACGT\n",
    "\n\r\n>a>b > c\nAC GT\n\n>>x\n\n>y\tz  w \r\nA\r\nC\r\n>",
    ">n" * 40 + "\nACGT>N\n" + ">m text\n" + ("ACGTACGT\n" * 30) + ">last\nA",
    ">only",
]


@pytest.mark.parametrize("split", [13, 1 << 20])
def test_both_fasta_readers_on_odd_files(spark, tmp_path, split):
    spark.dataSource.register(fasta.FastaDataSource)
    want = []
    for i, text in enumerate(ODD_FASTA):
        (tmp_path / f"{i}.fa").write_text(text, newline="")
        want += [r[1:] for r in fasta.parse_fasta(io.StringIO(text, newline="\n"))]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert rows(fasta.read_fasta(spark, str(tmp_path))) == [(i, *r) for i, r in enumerate(want)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert want[0] == ("s1", "len>5 copy", "ACGT") and want[1] == ("a>b", "> c", "AC GT") and ("y", "z  w ", "AC") in want
    assert sorted(tuple(r)[1:] for r in spark.read.format("fasta").load(str(tmp_path)).collect()) == sorted(want)


def test_fasta_errors(spark, tmp_path):
    (tmp_path / "lead.fa").write_text("ACGT\n>a\nA\n")
    with pytest.raises(Exception, match="before the first header"):
        fasta.read_fasta(spark, str(tmp_path / "lead.fa")).collect()
    with pytest.raises(EngineError) as e:
        fasta.read_fasta(spark, str(tmp_path / "none.fa"))
    assert e.value.code == "io_error"


def test_command_line(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">r0\nTTGATTACAGGACGTACGT\n>r1\nCCCCAAAATTTT\n")
    (tmp_path / "q.fa").write_text(">q0\nGATTACA\n")
    ix = "file://" + str(tmp_path / "ix")

    def call(*argv):
        out = io.StringIO()
        return cli.run(spark, list(argv), out), out.getvalue()

    assert call("build", "--reference", str(tmp_path / "r.fa"), "--output", ix)[0] == 0
    assert call("query", "--index", ix, "--pattern", "ACGT") == (0, "query_id\tsequence_id\tsequence_name\tstart\tend\tstrand\nquery_0\t0\tr0\t11\t15\t+\nquery_0\t0\tr0\t15\t19\t+\n")
    assert call("query", "--index", ix, "--pattern", "ACGT", "--count-only")[1].splitlines()[1] == "query_0\t2"
    assert call("mem", "--index", ix, "--query", str(tmp_path / "q.fa"), "--min-length", "5")[1].splitlines()[1] == "q0\t0\tr0\t2\t0\t7\t+"
    assert "reference_occurrences" in call("smem", "--index", ix, "--query", str(tmp_path / "q.fa"), "--min-length", "5")[1]
    assert call("inspect", "--index", ix)[1].startswith("key\tvalue")
    assert call("mem", "--index", ix, "--query", str(tmp_path / "q.fa"), "--min-length", "0")[0] == 3
    assert call("nonsense")[0] == 2
    fm = "file://" + str(tmp_path / "fm")
    assert call("build", "--type", "fm", "--reference", str(tmp_path / "r.fa"), "--output", fm)[0] == 0
    for more in (("--pattern", "ACGT"), ("--pattern", "TTTT", "--strand", "both"), ("--pattern", "ACGT", "--max-hits", "1"), ("--query", str(tmp_path / "q.fa"), "--count-only")):
        assert call("query", "--index", fm, *more) == call("query", "--index", ix, *more)
    assert call("query", "--index", fm, "--pattern", "A", "--batch-width", "999")[0] == 3 and call("query", "--index", ix, "--pattern", "A", "--algorithm", "child")[0] == 3
    assert call("mem", "--index", fm, "--query", str(tmp_path / "q.fa"))[0] == 3
    for name in ("right-maximal", "mam", "mum"):
        assert call(name, "--index", ix, "--query", str(tmp_path / "q.fa"), "--min-length", "7")[1].splitlines()[1] == "q0\t0\tr0\t2\t0\t7\t+"
    assert call("query", "--index", ix + "-none", "--pattern", "A")[0] == 4


def test_stream_and_callbacks(spark, tmp_path):
    c = contigs(spark, ["TTGATTACAGG"])
    queries(spark, ["GATTACA", "TTACA"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id string, sequence string").parquet(str(tmp_path / "in"))
    run = search_stream(stream, lambda b: maximal.mem(c, b, 5), str(tmp_path / "out"), str(tmp_path / "ck"))
    run.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out" / "batch=*"))
    assert rows(got.select("query_id", "length")) == [("0", 7), ("1", 5)]
    seen = []
    assert for_each_match(maximal.mem(c, queries(spark, ["GATTACA"]), 5), seen.append) == 1 == len(seen)
    with pytest.raises(EngineError):
        for_each_match(got, None)
    assert spark.range(1).select(dna.is_palindrome(F.lit("ACGT"))).first()[0]
