"""Index tables of the logical text as DataFrames: suffix array and its companions, BWT, directory, learned anchors.

Ranks come from prefix doubling: positions are ranked by their first 2**j symbols, then by the pair of ranks 2**j apart.
A global rank is the rank within a range partition plus the rows of the partitions before it, so no task sorts all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError, require
from ..functions.dna import kmer_key
from ..session import cut
from .exact import check_patterns, first_hits, stranded
from .exact import count as exact_count
from .kmers import words
from .reference import contig_offsets, map_global, text_symbols

BASE = 16


def global_rank(df: DataFrame, keys: list[str], partitions: int = 16) -> DataFrame:
    """``df`` with ``rank``: rows with smaller keys, over all of ``df``."""
    # equal keys go to one range, and the number of each range's rows is small data
    dealt = cut(df.repartitionByRange(partitions, *keys).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    inside = F.rank().over(Window.partitionBy("_p").orderBy(*keys)) - 1
    return dealt.withColumn("_r", inside).join(F.broadcast(before), "_p").withColumn("rank", (F.col("_b") + F.col("_r")).cast("long")).drop("_p", "_n", "_b", "_r")


def suffix_ranks(symbols: DataFrame, partitions: int = 16) -> list[tuple[int, DataFrame]]:
    """[(h, (pos, rank))]: positions ranked by their first h symbols, for h = 16, 32, ... until all ranks differ."""
    n = symbols.count()
    step = 1 << 12
    # the first 16 symbols of each position as a string; end symbols are unique, so shorter ones sort right
    chunks = symbols.groupBy(F.floor(F.col("pos") / step).alias("c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"].cast("string")), "").alias("s"))
    after = chunks.select((F.col("c") - 1).alias("c"), F.substring("s", 1, BASE).alias("t"))
    text = chunks.join(after, "c", "left").select("c", "s", F.concat("s", F.coalesce("t", F.lit(""))).alias("t"))
    each = F.transform(F.sequence(F.lit(0), F.length("s") - 1), lambda i: F.struct((F.col("c") * step + i).alias("pos"), F.substring("t", i + 1, F.lit(BASE)).alias("w")))
    first = text.select(F.explode(each).alias("x")).select("x.*")
    ranks = cut(global_rank(first, ["w"], partitions).select("pos", "rank"))
    levels, h = [(BASE, ranks)], BASE
    while ranks.select("rank").distinct().count() < n:
        later = ranks.select((F.col("pos") - h).alias("pos"), F.col("rank").alias("next"))
        pairs = ranks.withColumnRenamed("rank", "first").join(later, "pos", "left").fillna(-1, ["next"])
        ranks = cut(global_rank(pairs, ["first", "next"], partitions).select("pos", "rank"))
        h *= 2
        levels.append((h, ranks))
    return levels


def suffix_array(symbols: DataFrame) -> DataFrame:
    """(row, suffix) of the whole logical text; suffixes are compared across separators."""
    return suffix_ranks(symbols)[-1][1].select(F.col("rank").alias("row"), F.col("pos").alias("suffix"))


def sampled_suffix_array(sa: DataFrame, rate: int) -> DataFrame:
    """Rows of positions that ``rate`` divides, numbered anew."""
    require(rate >= 1, "sampling rate must be 1 at least")
    return global_rank(sa.where(F.col("suffix") % rate == 0).withColumnRenamed("row", "old"), ["old"]).select(F.col("rank").alias("row"), "suffix")


def inverse_suffix_array(sa: DataFrame) -> DataFrame:
    return sa.select(F.col("suffix").alias("position"), "row")


def lcp_array(symbols: DataFrame) -> DataFrame:
    """(row, suffix, lcp) with lcp the symbols shared with the row before.

    Where two positions have equal ranks at a level they share its symbols: from the widest level down, then one by one.
    """
    levels = suffix_ranks(symbols)
    sa = levels[-1][1].select(F.col("rank").alias("row"), F.col("pos").alias("suffix"))
    before = sa.select((F.col("row") + 1).alias("row"), F.col("suffix").alias("previous"))
    d = sa.join(before, "row", "left").withColumn("lcp", F.lit(0).cast("long"))
    for h, ranks in reversed(levels[:-1] or levels[:0]):
        for side in ("suffix", "previous"):
            look = ranks.select(F.col("pos").alias("_at"), F.col("rank").alias(f"_{side}"))
            d = d.join(look, F.col(side) + F.col("lcp") == F.col("_at"), "left").drop("_at")
        d = cut(d.withColumn("lcp", F.when(F.col("_suffix") == F.col("_previous"), F.col("lcp") + h).otherwise(F.col("lcp"))).drop("_suffix", "_previous"))
    # fewer symbols than the narrowest level are left; levels above may repeat once each, so 16 more suffice twice
    near = symbols.select("pos", "symbol")
    look = lambda side: d.select("row", (F.col(side) + F.col("lcp")).alias("at")).where("at IS NOT NULL").select("row", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2 * BASE - 1)), lambda i: F.struct(i.alias("i"), (F.col("at") + i).alias("p")))).alias("x")).select("row", "x.*").join(near, F.col("p") == F.col("pos")).select("row", "i", F.col("symbol").alias(side[0]))
    same = look("suffix").join(look("previous"), ["row", "i"]).groupBy("row").agg(F.min(F.when(F.col("s") != F.col("p"), F.col("i"))).alias("stop"), F.count(F.lit(1)).alias("n"))
    return d.join(same, "row", "left").select("row", "suffix", (F.col("lcp") + F.coalesce("stop", "n", F.lit(0))).cast("long").alias("lcp"))


def sampled_lcp(lcp: DataFrame, rate: int, rows_per_bucket: int = 1 << 16) -> DataFrame:
    """(row, suffix, lcp) of the sampled suffix array: the smallest value from the row after the kept one before up to the row itself.

    A row belongs to the next kept row, whose number is that of the kept rows before it. Kept rows are counted by buckets of
    rows, so no task walks all rows and one window sees a number for each bucket.
    """
    require(rate >= 1, "sampling rate must be 1 at least")
    d = cut(lcp.select("row", "suffix", "lcp", (F.col("suffix") % rate == 0).cast("long").alias("_k"), F.floor(F.col("row") / rows_per_bucket).alias("_b")))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy("_b").agg(F.sum("_k").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.sum("_k").over(Window.partitionBy("_b").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k")
    d = d.withColumn("_i", inside).join(sizes, "_b").groupBy((F.col("_before") + F.col("_i")).alias("row"))
    kept = d.agg(F.max(F.when(F.col("_k") == 1, F.col("suffix"))).alias("suffix"), F.min("lcp").alias("_least")).where("suffix IS NOT NULL")
    return kept.select("row", "suffix", F.when(F.col("row") == 0, F.lit(0)).otherwise(F.col("_least")).cast("long").alias("lcp"))


def byte_coded_lcp(lcp: DataFrame) -> DataFrame:
    """(row, suffix, code, overflow): codes of a byte, 255 for larger values, which are kept beside it."""
    big = F.col("lcp") >= 255
    return lcp.select("row", "suffix", F.least(F.col("lcp"), F.lit(255)).cast("int").alias("code"), F.when(big, F.col("lcp")).alias("overflow"))


def child_table(lcp: DataFrame) -> DataFrame:
    """(row, up, down, next_l) over the nested intervals of equal prefixes.

    ``up`` is the first smallest value of the stretch of larger values that ends before the row, ``down`` that of the stretch
    that begins after it, ``next_l`` the next row of the same value with none smaller between. All follow from the nearest smaller
    values on both sides: the first smallest value q of the stretch between them is the ``up`` of the right one if that is no smaller
    than the left one, and the ``down`` of the left one if that is no smaller than the right one. One task walks the rows in order.
    """

    def run(batches):
        pdf = pd.concat(list(batches)).sort_values("row")
        v, n = pdf["lcp"].to_numpy(), len(pdf)
        up, down, nxt = (np.full(n, -1, dtype=np.int64) for _ in range(3))
        open_: list[int] = []  # rows of values that do not fall; of equal ones all
        for i in range(n + 1):
            here = v[i] if i < n else -1
            while open_ and v[open_[-1]] > here:
                q = open_.pop()
                if open_ and v[open_[-1]] == v[q]:
                    continue  # not the first of its equals
                left = v[open_[-1]] if open_ else -1
                if i < n and left <= here:
                    up[i] = q
                if open_ and here <= left:
                    down[open_[-1]] = q
            if i < n:
                if open_ and v[open_[-1]] == here:
                    nxt[open_[-1]] = i
                open_.append(i)
        out = {"row": pdf["row"].to_numpy()}
        for name, a in (("up", up), ("down", down), ("next_l", nxt)):
            out[name] = pd.arrays.IntegerArray(a, a < 0)
        yield pd.DataFrame(out)

    return lcp.select("row", "lcp").repartition(1).mapInPandas(run, "row long, up long, down long, next_l long")


def bwt(symbols: DataFrame, sa: DataFrame) -> DataFrame:
    """(row, symbol): the symbol before each suffix, for position 0 the end symbol."""
    n = symbols.count()
    return sa.select("row", F.pmod(F.col("suffix") - 1, F.lit(n)).alias("pos")).join(symbols, "pos").select("row", "symbol")


def c_table(symbols: DataFrame) -> DataFrame:
    """(symbol, smaller): how many symbols of the text are smaller, for all seven."""
    counts = symbols.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    every = symbols.sparkSession.range(7).select(F.col("id").cast("int").alias("symbol")).join(counts, "symbol", "left").fillna(0)
    before = Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("symbol", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("smaller"))


def occurrences(bwt_rows: DataFrame, block: int = 4096) -> DataFrame:
    """(row, symbol, seen): how often the row's symbol stands before it; counted in blocks, so no window is long."""
    b = bwt_rows.withColumn("block", F.floor(F.col("row") / block))
    inside = F.row_number().over(Window.partitionBy("symbol", "block").orderBy("row")) - 1
    sums = b.groupBy("symbol", "block").agg(F.count(F.lit(1)).alias("n"))
    base = sums.select("symbol", "block", F.coalesce(F.sum("n").over(Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return b.withColumn("inside", inside).join(base, ["symbol", "block"]).select("row", "symbol", (F.col("base") + F.col("inside")).cast("long").alias("seen"))


def _search_held(held: bytes, c: list[int], patterns: DataFrame) -> DataFrame:
    """Backward search against a text whose BWT every worker holds."""
    spark = patterns.sparkSession
    shared = spark.sparkContext.broadcast((held, c))

    def run(batches):
        data, smaller = np.frombuffer(shared.value[0], dtype=np.uint8), shared.value[1]
        rows = [np.flatnonzero(data == s) for s in range(7)]
        for pdf in batches:
            out = []
            for digits in pdf["d"]:
                lo, hi = 0, len(data)
                for ch in reversed(digits):
                    s = int(ch)
                    lo, hi = (smaller[s] + int(np.searchsorted(rows[s], x)) for x in (lo, hi))
                    if lo >= hi:
                        lo = hi = 0
                        break
                out.append((lo, hi))
            yield pd.DataFrame({"query_id": pdf["query_id"], "begin": [x[0] for x in out], "end": [x[1] for x in out]})

    digits = F.translate(F.translate("pattern", "acgt", "ACGT"), "ACGT", "2345")
    return patterns.select("query_id", digits.alias("d")).mapInPandas(run, "query_id string, begin long, end long")


def fm_equal_range(bwt_rows: DataFrame, c: DataFrame, patterns: DataFrame, held_symbols: int = 1_000_000) -> DataFrame:
    """(query_id, begin, end) by backward search; an empty range is [0, 0).

    A text of at most ``held_symbols`` symbols (a byte each) is given to every worker. Beyond that all patterns take a
    symbol a step together, against the occurrence table: how often a symbol stands before a row is told by the next
    row that holds it.
    """
    n = bwt_rows.count()
    if n <= held_symbols:
        rows = bwt_rows.toPandas().sort_values("row")
        smaller = [r["smaller"] for r in c.orderBy("symbol").collect()]
        return _search_held(rows["symbol"].to_numpy().astype(np.uint8).tobytes(), smaller, patterns)
    occ = cut(occurrences(bwt_rows))
    total = occ.groupBy("symbol").agg(F.count(F.lit(1)).alias("total"))
    digits = F.translate(F.translate("pattern", "acgt", "ACGT"), "ACGT", "2345")
    state = patterns.select("query_id", digits.alias("d"), F.lit(0).cast("long").alias("lo"), F.lit(n).cast("long").alias("hi"))
    steps = patterns.agg(F.max(F.length("pattern"))).first()[0] or 0
    for i in range(steps):
        live = state.withColumn("symbol", F.when(F.length("d") > i, F.substring(F.col("d"), F.length("d") - i, F.lit(1)).cast("int")))
        asked = live.where("symbol IS NOT NULL").select("query_id", "symbol", F.explode(F.array("lo", "hi")).alias("row")).select("symbol", "row").distinct()
        # the nearest row at or after the asked one that holds the symbol, as a window over both
        both = occ.select("symbol", "row", "seen", F.lit(False).alias("ask")).unionByName(asked.select("symbol", "row", F.lit(None).cast("long").alias("seen"), F.lit(True).alias("ask")))
        after = Window.partitionBy("symbol").orderBy("row", F.col("ask").desc()).rowsBetween(0, Window.unboundedFollowing)
        got = both.withColumn("found", F.first("seen", ignorenulls=True).over(after)).where("ask").join(total, "symbol", "left").select("symbol", "row", F.coalesce("found", "total", F.lit(0)).alias("count"))
        smaller = live.join(F.broadcast(c), "symbol", "left")
        for side in ("lo", "hi"):
            smaller = smaller.join(got.select(F.col("symbol").alias("_s"), F.col("row").alias("_r"), F.col("count").alias(f"_{side}")), (F.col("symbol") == F.col("_s")) & (F.col(side) == F.col("_r")), "left").drop("_s", "_r")
        step = lambda side: F.when(F.col("symbol").isNull(), F.col(side)).otherwise(F.col("smaller") + F.col(f"_{side}"))
        state = cut(smaller.select("query_id", "d", step("lo").alias("lo"), step("hi").alias("hi")))
    some = F.col("hi") > F.col("lo")
    return state.select("query_id", F.when(some, F.col("lo")).otherwise(0).alias("begin"), F.when(some, F.col("hi")).otherwise(0).alias("end"))


def range_rows(ranges: DataFrame, piece: int = 1 << 16) -> DataFrame:
    """The columns of ``ranges`` but begin and end, with ``row`` for each row in [begin, end); no array holds a whole long range."""
    keep = [c for c in ranges.columns if c not in ("begin", "end")]
    pieces = ranges.where("end > begin").select(*keep, "end", F.explode(F.sequence(F.col("begin"), F.col("end") - 1, F.lit(piece).cast("long"))).alias("low"))
    return pieces.select(*keep, F.explode(F.sequence(F.col("low"), F.least(F.col("end"), F.col("low") + piece) - 1)).alias("row"))


def suffix_at(sa: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, suffix) of the asked rows; a row that the array lacks is refused when rows are read."""
    lost = F.raise_error(F.concat(F.lit("invalid_input: no row "), F.col("row").cast("string"))).cast("long")
    return rows.select("row").join(sa.select("row", "suffix"), "row", "left").select("row", F.coalesce("suffix", lost).alias("suffix"))


FM_BACKENDS = ("sdsl-csa-wt-huff", "sdsl-csa-wt-balanced", "sdsl-csa-wt-epr")  # fixed names; one implementation here


def check_fm(backend: str = FM_BACKENDS[0], batch_width: int = 0) -> None:
    """Names of layouts that can be searched, and widths of batches: 0 (as 16) to 256. Neither changes a result."""
    if backend not in FM_BACKENDS:
        raise EngineError("unsupported_backend", f"FM backend {backend!r}")
    require(0 <= batch_width <= 256, "batch_width must be in [0, 256]")


def _fm_hits(bwt_rows: DataFrame, c: DataFrame, patterns: DataFrame, strands: str, backend: str, batch_width: int) -> DataFrame:
    """query_id, strand, p, begin, end: each different string that is searched is searched once."""
    check_fm(backend, batch_width)
    check_patterns(patterns)
    asked = stranded(patterns, strands)
    found = fm_equal_range(bwt_rows, c, asked.select(F.col("p").alias("query_id"), F.col("p").alias("pattern")).distinct())
    return asked.join(found.withColumnRenamed("query_id", "p"), "p")


def fm_count(bwt_rows: DataFrame, c: DataFrame, patterns: DataFrame, strands: str = "forward", backend: str = FM_BACKENDS[0], batch_width: int = 0) -> DataFrame:
    """query_id, total_hits of every pattern by backward search, zero included."""
    hits = _fm_hits(bwt_rows, c, patterns, strands, backend, batch_width)
    return hits.groupBy("query_id").agg(F.sum(F.col("end") - F.col("begin")).alias("total_hits"))


def fm_locate(contigs: DataFrame, bwt_rows: DataFrame, c: DataFrame, sa: DataFrame, patterns: DataFrame, strands: str = "forward", max_hits: int | None = None, backend: str = FM_BACKENDS[0], batch_width: int = 0) -> DataFrame:
    """query_id, sequence_id, sequence_name, position, length, strand by backward search; the text is not scanned."""
    require(max_hits is None or max_hits >= 0, "max_hits must not be negative")
    rows = range_rows(_fm_hits(bwt_rows, c, patterns, strands, backend, batch_width)).join(sa.select("row", "suffix"), "row")
    at = map_global(contigs, rows.select(F.col("suffix").alias("global_pos"), F.lit(1).cast("long").alias("length")).distinct()).select(F.col("global_pos").alias("suffix"), "sequence_id", "position")
    names = contigs.select("sequence_id", F.col("name").alias("sequence_name"))
    hits = rows.join(at, "suffix").join(names, "sequence_id").select("query_id", "sequence_id", "sequence_name", "position", F.length("p").cast("long").alias("length"), "strand")
    return hits if max_hits is None else first_hits(hits, max_hits)


def equal_range(contigs: DataFrame, sa: DataFrame, patterns: DataFrame, sampling_rate: int = 1) -> DataFrame:
    """(query_id, begin, end): rows of the suffix array whose suffixes start with the pattern, by their places in the text."""
    if sampling_rate != 1:
        raise EngineError("unsupported_backend", "equal ranges need a complete suffix array")
    longest = patterns.agg(F.max(F.length("pattern"))).first()[0] or 1
    k = min(patterns.agg(F.min(F.length("pattern"))).first()[0] or 1, 31)
    hits = words(contigs, ["sequence_id"], "sequence", k, ahead=longest).join(F.broadcast(patterns.select("query_id", F.translate("pattern", "acgt", "ACGT").alias("p")).withColumn("word", F.substring("p", 1, k))), "word").where(F.startswith("ahead", "p"))
    at = hits.join(contig_offsets(contigs).select("sequence_id", "global_offset"), "sequence_id").select("query_id", (F.col("global_offset") + F.col("pos")).alias("suffix"))
    span = at.join(sa, "suffix").groupBy("query_id").agg(F.min("row").alias("begin"), (F.max("row") + 1).alias("end"))
    return patterns.select("query_id").join(span, "query_id", "left").fillna(0)


def prefix_directory(contigs: DataFrame, sa: DataFrame, k: int = 8) -> DataFrame:
    """(key, begin, end): rows of each word of k bases that occurs."""
    at = words(contigs, ["sequence_id"], "sequence", k).join(contig_offsets(contigs).select("sequence_id", "global_offset"), "sequence_id").select("word", (F.col("global_offset") + F.col("pos")).alias("suffix"))
    return at.join(sa, "suffix").groupBy("word").agg(F.min("row").alias("begin"), (F.max("row") + 1).alias("end")).select(kmer_key(F.col("word")).alias("key"), "begin", "end")


def learned_anchors(contigs: DataFrame, sa: DataFrame, k: int = 12, bucket_bits: int = 8) -> DataFrame:
    """(bucket, x, y): the smallest (key, row) of each bucket, gaps filled forwards, and the end anchor."""
    require(1 <= k <= 31, "k must be in [1, 31]")
    require(0 <= bucket_bits <= min(2 * k, 31), "bucket bits are out of range")
    at = words(contigs, ["sequence_id"], "sequence", k).join(contig_offsets(contigs).select("sequence_id", "global_offset"), "sequence_id").select(kmer_key(F.col("word")).alias("key"), (F.col("global_offset") + F.col("pos")).alias("suffix"))
    least = at.join(sa, "suffix").groupBy(F.shiftrightunsigned("key", 2 * k - bucket_bits).alias("bucket")).agg(F.min(F.struct("key", "row")).alias("a"))
    n = sa.count()
    every = contigs.sparkSession.range(1 << bucket_bits).withColumnRenamed("id", "bucket").join(least, "bucket", "left")
    w = Window.orderBy("bucket")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    held = F.last("a", ignorenulls=True).over(back)
    # before the first one that has any: key 0 and the first one's row
    first = F.first("a", ignorenulls=True).over(ahead)
    rows = every.withColumn("held", held).withColumn("first", first).select("bucket", F.coalesce("held.key", F.lit(0)).alias("x"), F.coalesce("held.row", "first.row", F.lit(0)).alias("y"))
    end = contigs.sparkSession.createDataFrame([(1 << bucket_bits, 1 << (2 * k), n)], "bucket long, x long, y long")
    return rows.unionByName(end)


def learned_predict(anchors: DataFrame, keys: DataFrame, sa_rows: int, k: int = 12, bucket_bits: int = 8) -> DataFrame:
    """(key, row): the row that linear interpolation between the two anchors of the key's bucket predicts."""
    q = keys.select("key").withColumn("bucket", F.shiftrightunsigned("key", 2 * k - bucket_bits))
    lo = anchors.select("bucket", F.col("x").alias("x0"), F.col("y").alias("y0"))
    hi = anchors.select((F.col("bucket") - 1).alias("bucket"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    d = q.join(F.broadcast(lo), "bucket").join(F.broadcast(hi), "bucket")  # 2**bucket_bits rows
    wide = lambda c: c.cast("decimal(38,0)")
    num = wide(F.col("key") - F.col("x0")) * wide(F.col("y1") - F.col("y0")) + wide(F.floor((F.col("x1") - F.col("x0")) / 2))
    inner = F.col("y0") + F.floor(num / wide(F.col("x1") - F.col("x0"))).cast("long")
    flat = (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")) | (F.col("key") <= F.col("x0"))
    row = F.when(flat, F.col("y0")).when(F.col("key") >= F.col("x1"), F.col("y1")).otherwise(inner)
    return d.select("key", F.least(row, F.lit(sa_rows - 1)).cast("long").alias("row"))


def storage_width(contigs: DataFrame, profile: str = "fast") -> DataFrame:
    """One row: symbols, the narrowest coordinate width (32, 40, 48 or 64 bits) and the profile's choice."""
    require(profile in ("fast", "low-memory"), f"unknown profile {profile!r}")
    n = contigs.agg((F.sum("length") + F.count(F.lit(1)) + 1).alias("symbols"))
    last = F.col("symbols") - 1
    width = F.when(last < 2**32, 32).when(last < 2**40, 40).when(last < 2**48, 48).otherwise(64)
    n = n.select("symbols", width.alias("narrowest"))
    return n.withColumn("width", F.when(F.lit(profile == "fast") & (F.col("narrowest") != 32), 64).otherwise(F.col("narrowest")))


def validate_index(symbols: DataFrame, sa: DataFrame) -> DataFrame:
    """One row of checks: the suffix array is a permutation, its rows are dense, the text ends in its only end symbol."""
    n = symbols.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("symbol") == 0).alias("ends"), F.max_by("symbol", "pos").alias("final")).first()
    s = sa.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("suffix").alias("suffixes"), F.countDistinct("row").alias("numbers"), F.min("row").alias("lo"), F.max("row").alias("hi"))
    lost = symbols.join(sa, symbols["pos"] == sa["suffix"], "left_anti").agg(F.count(F.lit(1)).alias("lost"))
    return s.crossJoin(lost).select((F.col("rows") == n["n"]).alias("complete"), ((F.col("suffixes") == F.col("rows")) & (F.col("lost") == 0)).alias("permutation"), ((F.col("numbers") == F.col("rows")) & (F.col("lo") == 0) & (F.col("hi") == F.col("rows") - 1)).alias("dense"), F.lit(n["ends"] == 1 and n["final"] == 0).alias("sentinel"))


def sampled_count(contigs: DataFrame, sampled: DataFrame, rate: int, patterns: DataFrame) -> DataFrame:
    """(query_id, total_hits) from a sampled suffix array: a hit has one sampled place among its first ``rate`` bases.

    The part of the pattern from there on is looked up among sampled suffixes, the bases before it are compared.
    Patterns shorter than ``rate`` are counted by scan, as they may hold no sampled place.
    """
    p = patterns.select("query_id", F.translate("pattern", "acgt", "ACGT").alias("p"))
    long_ = p.where(F.length("p") >= rate)
    longest = p.agg(F.max(F.length("p"))).first()[0] or 1
    offsets = contig_offsets(contigs).select("sequence_id", "global_offset")
    # sampled places with what follows, and the bases before them
    places = words(contigs, ["sequence_id"], "sequence", 1, ahead=longest).join(offsets, "sequence_id").withColumn("suffix", F.col("global_offset") + F.col("pos")).join(sampled.select("suffix"), "suffix")
    texts = contigs.select(F.col("sequence_id").alias("sid"), "sequence")
    tails = long_.withColumn("skip", F.explode(F.sequence(F.lit(0), F.lit(rate - 1)))).withColumn("tail", F.expr("substring(p, skip + 1)")).withColumn("word", F.substring("tail", 1, 1))
    hit = places.join(F.broadcast(tails), "word").where(F.startswith("ahead", "tail") & (F.col("pos") >= F.col("skip")))
    hit = hit.join(texts, F.col("sequence_id") == F.col("sid")).where(F.expr("substring(sequence, pos - skip + 1, skip) = substring(p, 1, skip)"))
    n = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_hits"))
    found = long_.select("query_id").join(n, "query_id", "left").fillna(0)
    short = patterns.where(F.length("pattern") < rate)
    return found if not short.limit(1).count() else found.unionByName(exact_count(contigs, short))
