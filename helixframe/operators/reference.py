"""References: contigs from records, offsets, statistics, fingerprint, coordinate mapping, logical text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError, require
from ..functions.dna import ambiguous_bases, normalize_bases, symbol_digits


def reference_from_records(records: DataFrame, check: bool = True) -> DataFrame:
    """Contigs (sequence_id, name, description, sequence, length, ambiguous_bases) of seq_order, name, description, sequence.

    ``check`` refuses an empty reference, empty names or sequences, and names that occur twice. Ids follow seq_order;
    only order and name go through the one window that numbers them.
    """
    if check:
        bad = records.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.trim("name"), F.lit("")) == "").alias("names"), F.count_if(F.coalesce(F.length("sequence"), F.lit(0)) == 0).alias("seqs")).first()
        require(bad["n"] > 0, "a reference needs one record at least")
        require(bad["names"] == 0, "empty record name")
        require(bad["seqs"] == 0, "empty sequence")
        twice = records.groupBy("name").count().where("count > 1").select("name").first()
        if twice:
            raise EngineError("invalid_input", f"record name {twice['name']!r} occurs twice")
    ids = records.select("seq_order", "name").withColumn("sequence_id", (F.row_number().over(Window.orderBy("seq_order", "name")) - 1).cast("long")).select("name", "sequence_id")
    seq = normalize_bases(F.col("sequence"))
    r = records.join(ids, "name").select("sequence_id", "name", F.coalesce("description", F.lit("")).alias("description"), seq.alias("sequence"))
    return r.withColumn("length", F.length("sequence").cast("long")).withColumn("ambiguous_bases", ambiguous_bases(F.col("sequence")))


def contig_offsets(contigs: DataFrame) -> DataFrame:
    """sequence_id, name, description, length, global_offset, ambiguous_bases."""
    before = Window.orderBy("sequence_id").rowsBetween(Window.unboundedPreceding, -1)
    meta = contigs.select("sequence_id", "name", "description", "length", "ambiguous_bases")
    return meta.withColumn("global_offset", F.coalesce(F.sum(F.col("length") + 1).over(before), F.lit(0)).cast("long")).select("sequence_id", "name", "description", "length", "global_offset", "ambiguous_bases")


def reference_stats(contigs: DataFrame) -> DataFrame:
    """One row: sequence_count, total_bases, ambiguous_bases, text_symbols."""
    s = contigs.agg(F.count(F.lit(1)).alias("sequence_count"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_bases"), F.coalesce(F.sum("ambiguous_bases"), F.lit(0)).cast("long").alias("ambiguous_bases"))
    return s.withColumn("text_symbols", F.col("total_bases") + F.col("sequence_count") + 1)


def sequence_info(contigs: DataFrame, sequence_id: int) -> DataFrame:
    """The contig's row of ``contig_offsets``; an id that does not exist is refused."""
    info = contig_offsets(contigs).where(F.col("sequence_id") == sequence_id)
    require(info.limit(1).count() == 1, f"no sequence {sequence_id}")
    return info


def map_global(contigs: DataFrame, positions: DataFrame, span: int = 1 << 16) -> DataFrame:
    """(global_pos, length) to contig-local (sequence_id, position); places that leave their contig vanish.

    An as-of join, the last offset at or before the place, within spans of ``span`` symbols: a contig has a row in each
    span that it or its separator reaches, so places anywhere in the text are looked up span by span.
    """
    span_of = lambda c: F.floor(c / span)
    reach = F.sequence(span_of(F.col("global_offset")), span_of(F.col("global_offset") + F.col("length")))
    offsets = contig_offsets(contigs).select(F.explode(reach).alias("span"), F.col("global_offset").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("length"), F.struct("sequence_id", F.col("global_offset").alias("start"), F.col("length").alias("size")).alias("contig"))
    place = F.col("global_pos").cast("long")
    places = positions.select(span_of(place).alias("span"), place.alias("at"), F.lit(1).alias("kind"), F.col("length").cast("long").alias("length"), F.lit(None).cast(offsets.schema["contig"].dataType).alias("contig"))
    w = Window.partitionBy("span").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    r = offsets.unionByName(places).select("at", "kind", "length", F.last("contig", ignorenulls=True).over(w).alias("contig")).where("kind = 1")
    return r.where("at - contig.start + length <= contig.size").select(F.col("at").alias("global_pos"), "length", "contig.sequence_id", (F.col("at") - F.col("contig.start")).alias("position"))


def logical_text(contigs: DataFrame) -> DataFrame:
    """One row ``text``: digits of all contigs, each but the last followed by a separator, then the end symbol.

    For references that fit a string; larger ones use ``text_symbols``.
    """
    rows = F.sort_array(F.collect_list(F.struct("sequence_id", symbol_digits(F.col("sequence")).alias("s"))))
    return contigs.agg(rows.alias("r")).select(F.concat(F.array_join(F.transform("r", lambda x: x["s"]), "1"), F.lit("10")).alias("text"))


def text_symbols(contigs: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """(pos, symbol) of the logical text, one row a symbol, from chunks of contigs."""
    offsets = contig_offsets(contigs).select("sequence_id", "global_offset")
    digits = F.concat(symbol_digits(F.col("sequence")), F.lit("1"))
    parts = contigs.select("sequence_id", digits.alias("s")).join(offsets, "sequence_id")
    starts = F.transform(F.sequence(F.lit(0), F.length("s") - 1, F.lit(chunk)), lambda i: F.struct((F.col("global_offset") + i).alias("at"), F.substring("s", i + 1, F.lit(chunk)).alias("p")))
    pieces = parts.select(F.explode(starts).alias("c")).select("c.at", F.split("c.p", "").alias("p"))
    body = pieces.select("at", F.posexplode("p")).where("col <> ''").select((F.col("at") + F.col("pos")).alias("pos"), F.col("col").cast("int").alias("symbol"))
    end = contigs.agg(F.sum(F.length("sequence") + 1).alias("pos")).select("pos", F.lit(0).alias("symbol"))
    return body.unionByName(end)


def fingerprint(contigs: DataFrame) -> DataFrame:
    """One row: FNV-1a-64 of the encoded bases with separators, as 16 hex digits.

    The hash runs from byte to byte, so one task takes the contigs one after another and holds one at a time.
    """
    prime, mask = 0x100000001B3, 2**64 - 1

    def run(batches):
        h, first = 0xCBF29CE484222325, True
        for pdf in batches:
            for digits in pdf["s"]:
                data = ("" if first else "1") + digits
                first = False
                for b in data.encode():
                    h = ((h ^ (b - 48)) * prime) & mask
        yield pd.DataFrame({"fingerprint": [f"{h:016x}"]})

    rows = contigs.select("sequence_id", symbol_digits(F.col("sequence")).alias("s")).repartition(1).sortWithinPartitions("sequence_id")
    return rows.mapInPandas(run, "fingerprint string")


def result_checksum(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and two checksums of the columns that no order changes: an exclusive or, and a sum, in which equal rows do not cancel."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns])
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    total = F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")) % F.lit(2**61 - 1).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor_checksum"), total.cast("long").alias("sum_checksum"))


def ordered_checksum(counts: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: rows taken in and FNV-1a-64, as 16 hex digits, of each query's number of hits followed by its hits, queries by id.

    ``counts`` has query_id and total_hits, zeros included, ``hits`` query_id, sequence_id, position, length, strand. Each value
    goes in as 8 bytes, lowest first; strands are 0, 1 and 2 for both. The order counts, so one task takes the sorted rows one after another.
    """
    prime, mask = 0x100000001B3, 2**64 - 1

    def run(batches):
        h, n = 0xCBF29CE484222325, 0
        for pdf in batches:
            for values in pdf["v"]:
                n += len(values) > 0
                for b in np.asarray(values, dtype="<i8").tobytes():
                    h = ((h ^ b) * prime) & mask
        yield pd.DataFrame({"n_rows": [n], "checksum": [f"{h:016x}"]})

    strand = F.when(F.col("strand") == "+", 0).when(F.col("strand") == "-", 1).otherwise(2).cast("long")
    place = ["sequence_id", "position", "length"]
    head = counts.select("query_id", *[F.lit(-1).cast("long").alias(c) for c in (*place, "_s")], F.array(F.col("total_hits").cast("long")).alias("v"))
    body = hits.select("query_id", *[F.col(c).cast("long").alias(c) for c in place], strand.alias("_s"), F.array(*[F.col(c).cast("long") for c in place], strand).alias("v"))
    none = counts.sparkSession.range(1).select(F.lit(None).cast("string").alias("query_id"), *[F.lit(-1).cast("long").alias(c) for c in (*place, "_s")], F.array().cast("array<long>").alias("v"))
    # with the empty row a task runs even where nothing was asked
    rows = none.unionByName(head).unionByName(body).repartition(1).sortWithinPartitions("query_id", *place, "_s").select("v")
    return rows.mapInPandas(run, "n_rows long, checksum string")


def synthetic_reference(seed: int, contigs: int, bases: int, ambiguous: float = 0.001) -> list[tuple[int, str, str, str]]:
    """Records of random contigs for benchmarks: repeats of a template and islands of N."""
    rng, out = np.random.default_rng(seed), []
    template = "".join(rng.choice(list("ACGT"), 1024))
    for i in range(contigs):
        seq = "".join(rng.choice(list("ACGT"), bases))
        at = int(rng.integers(0, max(1, bases - len(template))))
        seq = (seq[:at] + template + seq[at + len(template) :])[:bases]
        for p in rng.integers(0, bases, size=int(bases * ambiguous)).tolist():
            seq = seq[:p] + "N" + seq[p + 1 :]
        out.append((i, f"synthetic{i}", "", seq))
    return out
