"""FASTA as a Spark data source, plain or gzip.

``spark.dataSource.register(FastaDataSource)`` and ``spark.read.format("fasta").load(path)``, or ``read_fasta``, which
uses Spark's own text reader, so that any path Spark can open will do. A plain file is split at record starts;
a gzip file is one task's work.
"""

from __future__ import annotations

import glob
import gzip
import os
import re
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import EngineError, require

#: Splits up to which their first records are broadcast (some 200 bytes each).
MAX_SPLITS = 100_000
SCHEMA = "seq_order bigint, name string, description string, sequence string"


#: A name ends at the first white space of a header; the rest of the line is the description.
_NAME = re.compile(r"[^ \t\n\r\f\v]*").match


def parse_fasta(lines: Iterator[str]) -> Iterator[tuple[int, str, str, str]]:
    """(order, name, description, sequence); the name is the header's first word."""
    header, parts, order, raw = None, [], 0, ""
    for raw in lines:
        line = raw.rstrip("\r\n")
        if line.startswith(">"):
            if header is not None:
                yield (order, *header, "".join(parts))
                order += 1
            name = _NAME(line, 1).group()
            header, parts = (name, line[2 + len(name) :]), []
        elif header is not None:
            parts.append(line)
        elif line.strip():
            raise EngineError("invalid_input", "FASTA text before the first header")
    if header is not None and raw != ">":  # a lone > at the end begins nothing
        yield (order, *header, "".join(parts))


class FastaDataSource(DataSource):
    """Reads ``path`` (a file, a folder or a pattern); one partition for each file, orders counted within a file."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FastaReader(self.options)


class _FastaReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path", "")

    def partitions(self):
        found = sorted(glob.glob(os.path.join(self.path, "*"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not found:
            raise EngineError("io_error", f"no such file: {self.path}")
        return [InputPartition(p) for p in found]

    def read(self, partition):
        opener = gzip.open if partition.value.endswith(".gz") else open
        try:
            with opener(partition.value, "rt", newline="\n") as f:
                yield from parse_fasta(f)
        except (OSError, EOFError) as e:
            raise EngineError("invalid_input", f"{partition.value}: {e}") from e


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """seq_order, name, description, sequence of FASTA files, through Spark's text reader.

    Records begin at ``>`` in the first place of a line, as in ``parse_fasta``; a ``>`` elsewhere in a header is text.
    Text before a file's first header is refused when rows are read (``raise_error``), a missing path at once. Orders
    count over files by path: splits are read in order inside a task, so a record's order is the records of the splits
    before its own (one row a split is all that is gathered) and its place within the split; sequences are not shuffled.
    """
    try:
        raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    except AnalysisException as e:
        raise EngineError("io_error", f"no such file: {path}") from e
    raw = raw.withColumn("at", F.monotonically_increasing_id())
    splits = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.min_by(F.length(F.translate("value", " \t\r\n", "")), "at").alias("lead"))
    # a file may begin with blank lines: what stands before its first header is then no record
    splits = splits.withColumn("blank", ((F.col("block") == 0) & (F.col("lead") == 0)).cast("int"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    splits = splits.select("file", "block", "first", "blank", F.coalesce(F.sum(F.col("n") - F.col("blank")).over(before), F.lit(0)).alias("base"))
    r = raw.join(F.broadcast(splits) if splits.count() <= MAX_SPLITS else splits, ["file", "block"])
    lead = (F.col("block") == 0) & (F.col("at") == F.col("first"))
    r = r.where(~(lead & (F.col("blank") == 1)))
    orphan = F.raise_error(F.concat(F.lit("invalid_input: FASTA text before the first header in "), F.col("file"))).cast("string")
    opening = F.ltrim(F.col("value"), F.lit(" \t\r\n"))
    text = F.when(~lead, F.col("value")).when(F.startswith(opening, F.lit(">")), F.substring(opening, 2, F.length("value"))).otherwise(orphan)
    r = r.select((F.col("base") + F.col("at") - F.col("first") - F.col("blank") * (F.col("block") == 0).cast("int")).cast("long").alias("seq_order"), text.alias("value"))
    head = F.rtrim(F.substring_index("value", "\n", 1), F.lit("\r"))
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), "\r?\n|\r$", "")
    return r.select("seq_order", F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_extract(head, r"(?s)^\S*\s(.*)$", 1).alias("description"), body.alias("sequence"))


def write_fasta(rows: list[tuple[str, str, str]], path: str, width: int = 60) -> None:
    """A small FASTA file from (name, description, sequence); gzip if the name ends in .gz."""
    require(bool(rows), "no records")
    with (gzip.open if path.endswith(".gz") else open)(path, "wt") as f:
        for name, description, seq in rows:
            f.write(f">{name} {description}".rstrip() + "\n")
            f.writelines(seq[i : i + width] + "\n" for i in range(0, len(seq), width))
